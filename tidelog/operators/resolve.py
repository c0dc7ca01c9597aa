"""The newest state of each key.

``ops`` has ``seq``, ``op`` (0 deletes, 1 puts) and the columns of a row.  Two
operations on one key never have the same ``seq``.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import copysign
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

DELETE, PUT = 0, 1


def key_columns(df: DataFrame, pk: Sequence[str]) -> list[Column]:
    """What groups rows by key.

    Grouping takes -0.0 and 0.0 for one, but they are different keys; a float
    key is therefore grouped by its text as well, which tells them apart.
    """
    found: list[Column] = []
    for k in pk:
        found.append(F.col(k))
        if isinstance(df.schema[k].dataType, T.FloatType | T.DoubleType):
            found.append(F.col(k).cast("string"))
    return found


def same_key(a: DataFrame, b: DataFrame, pk: Sequence[str], name: str = "{}") -> Column:
    """Whether a row of ``a`` and one of ``b`` have the same key; ``name`` makes the columns' names in ``b``.

    As in :func:`key_columns`, equal floats must also agree as text.
    """
    found = F.lit(True)
    for k in pk:
        left, right = a[k], b[name.format(k)]
        found = found & left.eqNullSafe(right)
        if isinstance(a.schema[k].dataType, T.FloatType | T.DoubleType):
            found = found & left.cast("string").eqNullSafe(right.cast("string"))
    return found


def distinct_keys(df: DataFrame, pk: Sequence[str], name: str) -> DataFrame:
    """The keys of ``df``, each once, for a join by :func:`same_key`; a busy key is one row a task before the shuffle."""
    text = [c.alias(f"_c{i}") for i, c in enumerate(key_columns(df, pk))]
    found = df.select(*[F.col(k).alias(name.format(k)) for k in pk], *text)
    return found.dropDuplicates([f"_c{i}" for i in range(len(text))]).drop(*[f"_c{i}" for i in range(len(text))])


def key_order(df: DataFrame, pk: Sequence[str]) -> list[Column]:
    """The order of keys; sorting takes -0.0 and 0.0 for equal, but -0.0 comes first."""
    found: list[Column] = []
    for k in pk:
        found.append(F.col(k))
        if isinstance(df.schema[k].dataType, T.FloatType | T.DoubleType):
            found.append(F.col(k).cast("string").startswith("-").desc())
    return found


def visible(ops: DataFrame, as_of: int | None) -> DataFrame:
    """Operations up to ``as_of``, which counts; the bound reaches the scan."""
    return ops if as_of is None else ops.where(F.col("seq") <= as_of)


def newest(ops: DataFrame, pk: Sequence[str]) -> DataFrame:
    """The newest operation of each key, deletions too.

    A rank of one lets Spark keep one row per key and task before the shuffle,
    so a key with very many versions does not gather them in one place.
    """
    order = W.partitionBy(*key_columns(ops, pk)).orderBy(F.desc("seq"))
    return ops.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def current_state(ops: DataFrame, pk: Sequence[str], as_of: int | None = None) -> DataFrame:
    """Live rows, with the seq that wrote them, as of ``as_of``."""
    return newest(visible(ops, as_of), pk).where(F.col("op") == PUT).drop("op")


def in_version_order(ops: DataFrame, pk: Sequence[str]) -> DataFrame:
    """All versions by key, the newest of each first."""
    return ops.orderBy(*key_order(ops, pk), F.desc("seq"))


def _negative(c: Column) -> Column:
    return c.cast("string").startswith("-")


def _equal(c: Column, v: Any) -> Column:
    """c = v as keys: the zeros are two."""
    if isinstance(v, float) and v == 0:
        return (c == F.lit(v)) & (_negative(c) if copysign(1, v) < 0 else ~_negative(c))
    return c == F.lit(v)


def _less(c: Column, v: Any) -> Column:
    """c < v as keys: -0.0 is less than 0.0."""
    if isinstance(v, float) and v == 0 and copysign(1, v) > 0:
        return (c <= F.lit(v)) & ((c < F.lit(v)) | _negative(c))
    return c < F.lit(v)


def _not_less(c: Column, v: Any) -> Column:
    return (c >= F.lit(v)) & ~_less(c, v) if isinstance(v, float) and v == 0 else c >= F.lit(v)


def _more(c: Column, v: Any) -> Column:
    """c > v as keys: 0.0 is more than -0.0."""
    return _not_less(c, v) & ~_equal(c, v) if isinstance(v, float) and v == 0 else c > F.lit(v)


def _bound(pk: Sequence[str], key: Sequence[Any], below: bool) -> Column:
    """pk < key or pk >= key, column by column, as a condition that Parquet can use.

    The comparison of structs would say the same, but is not pushed down.
    """
    if len(key) != len(pk):
        raise ValueError(f"a bound has {len(pk)} columns")
    cut: Column | None = None
    for k, v in reversed(list(zip(pk, key, strict=True))):
        c, last = F.col(k), cut is None
        if below:
            cut = _less(c, v) if last else _less(c, v) | (_equal(c, v) & cut)
        else:
            cut = _not_less(c, v) if last else _more(c, v) | (_equal(c, v) & cut)
    if len(pk) > 1:  # a plain bound on the first column prunes row groups
        first = F.col(pk[0])
        cut = cut & (first <= F.lit(key[0]) if below else first >= F.lit(key[0]))
    return cut


def in_range(pk: Sequence[str], start: Sequence[Any] | None, end: Sequence[Any] | None) -> Column:
    """start <= pk < end, either side open if None."""
    found = F.lit(True)
    if start is not None:
        found = found & _bound(pk, start, below=False)
    if end is not None:
        found = found & _bound(pk, end, below=True)
    return found


def range_scan(
    ops: DataFrame,
    pk: Sequence[str],
    start: Sequence[Any] | None = None,
    end: Sequence[Any] | None = None,
    as_of: int | None = None,
    ordered: bool = False,
) -> DataFrame:
    """Live rows with ``start <= pk < end``, in key order if asked for.  Only that range is read."""
    found = current_state(ops.where(in_range(pk, start, end)), pk, as_of)
    return found.orderBy(*key_order(found, pk)) if ordered else found


def point_lookup(ops: DataFrame, pk: Sequence[str], key: Sequence[Any], as_of: int | None = None) -> DataFrame:
    """The live row of one key, or none."""
    return current_state(ops.where(is_key(pk, key)), pk, as_of)


def is_key(pk: Sequence[str], key: Sequence[Any]) -> Column:
    """Whether a row has this key."""
    same = F.lit(True)
    for k, v in zip(pk, key, strict=True):
        same = same & _equal(F.col(k), v)
    return same


def dedup_sql(view: str, pk: Sequence[str], columns: Sequence[str], floats: Sequence[str] = ()) -> str:
    """The query by which any engine reads the live rows from a log of versions.

    ``floats`` names the key columns that are floats: most engines group -0.0 and 0.0 together.
    """
    by = ", ".join([*pk, *[f"CAST({k} AS STRING)" for k in floats]])
    names = ", ".join(columns)
    return (
        f"SELECT {names} FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY seq DESC) AS rn FROM {view}) v "
        "WHERE rn = 1 AND op = 1"
    )
