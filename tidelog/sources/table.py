"""A keyed table on storage.

Three things persist: the log, append-only Parquet files ``(seq, op, row)``; the
base, levels of Parquet files clustered by key that hold the state at
``base_seq``; and the manifests that name them.  Every read is a query over the
base and the operations after it; no read depends on when files were merged.

Merges go level by level: the oldest log files into level 1, a part of a full
level into the next, each with the files there that its keys overlap and no
others.  :meth:`KeyedTable.flush` marks the stored rows that newer operations
replaced, by position; once all are marked, the state is what is left, and
reading it needs no shuffle of the rows.

A batch of operations is one commit and owns consecutive sequence numbers.  A
DataFrame has no order, so a batch given as one names the columns that order it.
"""

from __future__ import annotations

import io
import math
import re
import time
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, replace
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.errors import (
    AlreadyExistsError,
    BelowRetentionError,
    ClosedError,
    InvalidArgumentError,
    NotFoundError,
    ReadOnlyError,
    SchemaMismatchError,
)
from tidelog.functions.keys import encode, pk_bytes
from tidelog.operators import feed, merge, picker, resolve
from tidelog.operators.picker import Policy
from tidelog.operators.stats import level_stats
from tidelog.schema import ColumnSpec, TableSchema, check_row, check_value, pad, same_type, violation
from tidelog.sources import manifest as snapshots
from tidelog.sources.manifest import DataFile, Manifest
from tidelog.sources.metrics import Metrics
from tidelog.sources.storage import Storage


@dataclass(frozen=True)
class Options:
    """``compact_after`` log batches beyond the base trigger merges at the next write, 0 never; :meth:`KeyedTable.merge`
    waits for ``l0_trigger`` log files or for a level over its ``level_bytes``, and takes at most ``max_merge_bytes`` of a
    level at once.  Files have about ``target_file_bytes`` and at most ``max_records_per_file``; ``grace_s`` is how long
    unused files stay.  With ``mark_superseded`` every write marks what it replaced.  A batch of rows that another
    writer's commit got ahead of is numbered and written again up to ``retries`` times."""

    compact_after: int = 20
    max_records_per_file: int = 5_000_000
    grace_s: int = 300
    bloom_columns: tuple[str, ...] = ()
    retries: int = 0
    l0_trigger: int = Policy.l0_trigger
    l0_slowdown: int = Policy.l0_slowdown
    level_bytes: tuple[int, ...] = Policy.level_bytes
    max_merge_bytes: int = Policy.max_bytes
    max_merge_rows: int | None = None
    target_file_bytes: int = 512 << 20
    mark_superseded: bool = False

    @property
    def policy(self) -> Policy:
        return Policy(self.l0_trigger, self.l0_slowdown, self.level_bytes, self.max_merge_bytes, self.max_merge_rows)


#: A batch of so many rows that the driver has is written by the driver.
SMALL_BATCH = 20_000
#: So many files are told apart by comparing their names, more by their paths.
MAX_CASES = 64
#: Lists of more files than this, and more marks, a number each, are joined by shuffle.
MAX_BROADCAST_FILES, MAX_BROADCAST_MARKS = 100_000, 2_000_000
#: A position as one number has the row's in so many bits, and the file's above them.
_ROW_BITS = 40
#: Merges that one call of compact() makes at most.
MAX_MERGES = 128


class WriteBatch:
    """Operations that are committed together, when there are ``max_rows`` of them and at the end of the ``with`` block.

    What has not been committed is checked but has no number and is not seen by
    readers.  An error in the block drops it.
    """

    def __init__(self, table: KeyedTable, max_rows: int):
        self._table, self._max, self._held = table, max_rows, []

    def put(self, row: dict[str, Any]) -> None:
        check_row(self._table.schema, row)
        self._add(("put", row))

    def delete(self, *key: Any) -> None:
        encode(self._table.schema, key)
        self._add(("delete", key))

    def _add(self, operation: tuple[str, Any]) -> None:
        self._held.append(operation)
        if len(self._held) >= self._max:
            self.commit()

    def commit(self) -> int:
        """Commit what is held; the newest visible operation."""
        held, self._held = self._held, []
        self._table.apply_batch(held)
        return self._table.read_seq()

    def __enter__(self) -> WriteBatch:
        return self

    def __exit__(self, kind: type | None, *_: Any) -> None:
        if kind is None:
            self.commit()


_ARROW = {
    "boolean": pa.bool_(), "integer": pa.int32(), "long": pa.int64(), "float": pa.float32(), "double": pa.float64(),
    "binary": pa.binary(), "string": pa.string(),
}


def _value_stats(c: ColumnSpec, values: list[Any]) -> dict[str, Any]:
    """A column's statistics from its values, as a pass over the written file gives them."""
    known = [v for v in values if v is not None]
    whole = [v for v in known if v == v]  # NaN is greater than all
    low, high = (min(whole), max(whole)) if whole else (None, None)
    if len(whole) < len(known):
        low, high = (math.nan if low is None else low), math.nan

    def text(v: Any) -> str | None:
        if v is None or isinstance(v, str):
            return v
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, float):
            return "NaN" if math.isnan(v) else repr(v)
        return bytes(v).hex().upper() if isinstance(v, bytes) else str(v)

    return {"values": len(known), "nulls": len(values) - len(known), "min": text(low), "max": text(high)}


def _below_root(path: Column) -> Column:
    """A stored file's path below its table's root, from any spelling of its whole path: ``kind/folder/file``."""
    return F.substring_index(path, "/", -3)


def _by_file(files: Sequence[DataFile], value: Callable[[DataFile], Any], other: Column) -> Column:
    """A value of the file that a row was read from: compared by name where there are few files, else ``other``."""
    found, name = other, F.col("_metadata.file_name")
    for f in files if len(files) <= MAX_CASES else []:
        found = F.when(name == f.path.rpartition("/")[2], F.lit(value(f))).otherwise(found)
    return found


def _positions(files: Sequence[DataFile]) -> list[Column]:
    """The file below the root, and the row's number in it, of rows read from stored files."""
    path = _by_file(files, lambda f: f.path, _below_root(F.col("_metadata.file_path")))
    return [path.alias("file_path"), F.col("_metadata.row_index").alias("row_index")]


def _placed(rows: DataFrame, files: Sequence[DataFile]) -> DataFrame:
    return rows.select("*", *_positions(files))


class KeyedTable:
    """See the module.  Made by :meth:`open` and :meth:`open_read_only`."""

    def __init__(self, spark: SparkSession, store: Storage, manifest: Manifest, read_only: bool, options: Options):
        self._spark, self._store, self._manifest = spark, store, manifest
        self._read_only, self._closed, self.options = read_only, False, options
        self._pins: Counter[frozenset[str]] = Counter()
        self.metrics = Metrics()

    # opening and closing

    @classmethod
    def open(
        cls, spark: SparkSession, path: str, schema: TableSchema | None = None, options: Options | None = None
    ) -> KeyedTable:
        """Create the table, or open it and evolve its schema to the declared one if that only adds columns."""
        store = Storage(spark, path)
        if snapshots.latest_id(store):
            found = snapshots.load(store)
            if schema is not None:
                grown = found.schema.check_reopen(schema)
                if grown.schema_id != found.schema.schema_id:
                    found = found.apply(schema=grown)
                    snapshots.commit(store, found)
        elif schema is None:
            raise NotFoundError(f"no table at {path}")
        else:
            found = Manifest(1, schema)
            snapshots.commit(store, found)
        return cls(spark, store, found, False, options or Options())

    @classmethod
    def open_read_only(cls, spark: SparkSession, path: str) -> KeyedTable:
        store = Storage(spark, path)
        return cls(spark, store, snapshots.load(store), True, Options())

    def close(self) -> None:
        """Refuse writes from now on; reads go on."""
        self._closed = True

    def is_closed(self) -> bool:
        return self._closed

    def _writable(self) -> None:
        if self._read_only:
            raise ReadOnlyError("the table was opened for reading")
        if self._closed:
            raise ClosedError("the table is closed")

    def install_metrics_recorder(self, recorder: Callable[[str, int], None]) -> None:
        """Call ``recorder(name, value)`` whenever a counter of :attr:`metrics` goes up or a histogram gets a value."""
        self.metrics.recorder = recorder

    def _count(self, name: str, by: int = 1) -> None:
        self.metrics.count(name, by)

    # what it is

    @property
    def schema(self) -> TableSchema:
        return self._manifest.schema

    @property
    def pk(self) -> list[str]:
        return list(self.schema.primary_key)

    def read_seq(self) -> int:
        """The newest visible operation, 0 on an empty table."""
        return self._manifest.next_seq - 1

    def catalog_path(self) -> str:
        return self._store.root

    def snapshot(self) -> Manifest:
        return self._manifest

    # writing

    def put(self, row: dict[str, Any]) -> int:
        """Insert or replace one row; its sequence number."""
        return self.put_batch([row])

    def put_batch(self, rows: Sequence[dict[str, Any]]) -> int:
        return self.apply_batch([("put", r) for r in rows])

    def delete(self, *key: Any) -> int:
        """Delete a key, whether it is there or not; the deletion's sequence number."""
        return self.apply_batch([("delete", key)])

    def apply_batch(self, operations: Iterable[tuple[str, Any]]) -> int:
        """("put", row) and ("delete", key) in order, all or none; the first sequence number.

        An empty batch writes nothing and returns the newest visible one.
        """
        self._writable()
        rows = []
        for kind, what in operations:
            if kind == "put":
                rows.append((1, *check_row(self.schema, what)))
            elif kind == "delete":
                key = what if isinstance(what, tuple | list) else (what,)
                encode(self.schema, tuple(key))
                named = {k: check_value(self.schema[k], v) for k, v in zip(self.pk, key, strict=True)}
                rows.append((0, *[named.get(c.name) for c in self.schema.columns]))
            else:
                raise InvalidArgumentError(f"an operation is put or delete, not {kind}")
        if not rows:
            return self.read_seq()
        self._count("puts", sum(r[0] for r in rows))
        self._count("deletes", sum(1 - r[0] for r in rows))
        for left in range(self.options.retries, -1, -1):
            first = self._manifest.next_seq
            numbered = [(first + i, *r) for i, r in enumerate(rows)]
            try:
                with self.metrics.timed("write_ms"):
                    if len(numbered) <= SMALL_BATCH:
                        files = [self._write_rows(numbered)]
                    else:
                        files = self._write_files(self._spark.createDataFrame(numbered, self.schema.log_struct()), level=0)
                    return self._append(files, first, len(rows))
            except AlreadyExistsError:
                if not left:
                    raise
                was = self.schema
                self.refresh()
                if self.schema != was:  # the rows were checked against another schema
                    raise

    def write(self, df: DataFrame, order_by: Sequence[str], op: str | None = None) -> int:
        """A batch of any size, in the order of ``order_by``; ``op`` names a column of 0 and 1, else all are puts.

        Rows are sorted into staged files, and a row's number is its place there,
        so nothing is ranked in one task; with their numbers they are then
        written by key.
        """
        self._writable()
        keep = [c for c in df.columns if c in self.schema.names]
        extra = [c for c in df.columns if c not in keep and c != op and c not in order_by]
        if extra:
            raise SchemaMismatchError(f"no column {extra[0]}")
        same_type(df.select(*keep), self.schema)
        sorting = df.select(
            *[F.col(c) for c in keep],
            (F.col(op).cast("int") if op else F.lit(1)).alias("_op"),
            *[F.col(c).alias(f"_by{i}") for i, c in enumerate(order_by)],
        )
        missing = [c for c in self.schema.columns if c.name not in keep]
        for c in missing:
            value = c.default()
            if value is None and not c.nullable:
                raise SchemaMismatchError(f"{c.name} may not be null")
            sorting = sorting.withColumn(c.name, F.lit(value).cast(c.spark_type))
        by = [f"_by{i}" for i in range(len(order_by))]
        # a bad row stops the job that writes; there is no pass of its own for the check
        why = violation(self.schema, F.col("_op") == 0)
        sorting = sorting.withColumn("_op", F.when(why.isNull(), F.col("_op")).otherwise(F.raise_error(why).cast("int")))
        staging = f"staging/{uuid.uuid4().hex}"
        url = self._store.url(staging)
        try:
            try:
                sorting.orderBy(*by).drop(*by).write.parquet(url)
            except Exception as e:
                if m := re.search(r"USER_RAISED_EXCEPTION\]\s*([^\n]*?)(?: SQLSTATE.*)?$", str(e), re.M):
                    raise SchemaMismatchError(m[1]) from e
                raise
            staged = self._spark.read.parquet(url).select(
                "*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row")
            )
            counts = sorted((r[0], r[1]) for r in staged.groupBy("_file").agg(F.count("*")).collect())
            total, before, first = 0, [], self._manifest.next_seq
            for name, n in counts:  # part files are named in the order of their ranges
                before.append((name, total))
                total += n
            if not total:
                return self.read_seq()
            offsets = F.broadcast(self._spark.createDataFrame(before, "_file string, _before long"))
            frame = staged.join(offsets, "_file").select(
                (F.col("_before") + F.col("_row") + first).alias("seq"),
                F.col("_op").alias("op"),
                *[F.col(c.name).cast(c.spark_type).alias(c.name) for c in self.schema.columns],
            )
            with self.metrics.timed("write_ms"):
                return self._append(self._write_files(frame, level=0), first, total)
        finally:
            self._store.delete(staging)

    def batch(self, max_rows: int = 10_000) -> WriteBatch:
        """Many small writes as few commits: ``with table.batch() as b: b.put(row); b.delete(key)``."""
        self._writable()
        return WriteBatch(self, max_rows)

    def _append(self, files: list[DataFile], first: int, n: int) -> int:
        self._publish(self._manifest.apply(add=files, next_seq=first + n))
        self.metrics.observe("batch_rows", n)
        self._count("batches")
        self._count("bytes_written", sum(f.bytes for f in files))
        pending = len({f.path.rpartition("/")[0] for f in self._manifest.pending})
        if self.options.compact_after and pending >= self.options.compact_after:
            self.compact()
        if self.options.mark_superseded:
            self.flush()
        return first

    def _write_rows(self, rows: list[tuple]) -> DataFile:
        """A log file of a few rows that the driver has; no Spark job is worth its cost for them."""
        names = self.schema.log_struct().names
        at = [names.index(k) for k in self.pk]
        keyed = sorted(((encode(self.schema, tuple(r[i] for i in at)), -r[0], r) for r in rows), key=lambda x: x[:2])
        arrays = [pa.array(c, _ARROW[f.dataType.typeName()]) for c, f in zip(zip(*[r for *_, r in keyed], strict=True), self.schema.log_struct(), strict=True)]
        data = io.BytesIO()
        pq.write_table(pa.table(arrays, names=names), data, compression="snappy")
        path = f"log/{uuid.uuid4().hex}/part-00000-{uuid.uuid4().hex}.parquet"
        self._store.put_whole(path, data.getvalue())
        stats = {c.name: _value_stats(c, [r[i] for r in rows]) for i, c in enumerate(self.schema.columns, 2)}
        low, high = keyed[0][0], keyed[-1][0]
        return DataFile(
            path, 0, len(rows), len(data.getvalue()), rows[0][0], rows[-1][0], low.hex().upper(), high.hex().upper(),
            self.schema.schema_id, sum(r[1] for r in rows), None, stats,
        )

    def _write_files(self, frame: DataFrame, level: int) -> list[DataFile]:
        """Write a folder of Parquet files and gather their statistics in one pass over them."""
        folder = f"{'log' if level == 0 else 'base'}/{uuid.uuid4().hex}"
        out = frame.sortWithinPartitions(*resolve.key_order(frame, self.pk), F.desc("seq")).write
        out = out.option("maxRecordsPerFile", self.options.max_records_per_file)
        for c in self.options.bloom_columns:
            out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
        out.parquet(self._store.url(folder))
        sizes = {name.rpartition("/")[2]: size for name, size in self._store.list(folder) if name.endswith(".parquet")}
        written = self._spark.read.schema(frame.schema).parquet(self._store.url(folder))
        written = written.select("*", F.col("_metadata.file_name").alias("_file"), F.hex(pk_bytes(self.schema)).alias("_key"))
        key = F.col("_key")
        parts = [F.count("*").alias("n"), F.min("seq").alias("low"), F.max("seq").alias("high"), F.min(key).alias("kmin"), F.max(key).alias("kmax")]
        live = F.count_if(F.col("op") == 1) if "op" in frame.columns else F.count("*")
        parts.append(live.alias("live"))
        for i, c in enumerate(self.schema.columns):
            text = F.hex(c.name) if c.type == "binary" or c.fixed else F.col(c.name).cast("string")
            parts += [F.count_if(F.col(c.name).isNull()).alias(f"nulls{i}")]
            low, high = F.min(c.name), F.max(c.name)
            if c.type == "binary" or c.fixed:
                low, high = F.min(text), F.max(text)
            parts += [low.cast("string").alias(f"min{i}"), high.cast("string").alias(f"max{i}")]
        rows = written.groupBy(F.col("_file").alias("file")).agg(*parts).collect()  # a row for each file
        found = []
        for r in sorted(rows, key=lambda r: r["file"]):
            stats = {
                c.name: {"values": r["n"] - r[f"nulls{i}"], "nulls": r[f"nulls{i}"], "min": r[f"min{i}"], "max": r[f"max{i}"]}
                for i, c in enumerate(self.schema.columns)
            }
            found.append(
                DataFile(
                    f"{folder}/{r['file']}", level, r["n"], sizes[r["file"]], r["low"], r["high"], r["kmin"], r["kmax"],
                    self.schema.schema_id, r["live"], None, stats,
                )
            )
        return found

    # reading

    def _read(self, files: Sequence[DataFile], marks: Sequence[str] = (), positions: bool = False) -> DataFrame:
        """``seq``, ``op`` and the current columns of the files, without the rows at the positions in ``marks``.

        Files of one schema are read together; what they lack reads as its
        initial default.  A null that was written stays null.
        """
        current, at = self.schema, ("file_path", "row_index") if positions else ()
        empty = self._spark.createDataFrame([], current.log_struct())
        if positions:
            empty = empty.withColumns({"file_path": F.lit(""), "row_index": F.lit(0).cast("long")})
        found = None
        for schema_id in sorted({f.schema_id for f in files}):
            own, then = [f for f in files if f.schema_id == schema_id], self._manifest.schema_of(schema_id)
            part = self._spark.read.schema(then.log_struct()).parquet(*[self._store.url(f.path) for f in own])
            if marks and len(own) <= MAX_CASES:
                first = _by_file(own, lambda f: f.first_row_id, F.lit(None).cast("long"))
                part = part.select("*", *(_positions(own) if positions else []), (first + F.col("_metadata.row_index")).alias("row_id"))
            elif marks or positions:
                part = _placed(part, own)
                part = self._with_row_id(part, own) if marks else part
            if marks:
                # by one number instead of path and place, which is quick to look up
                m = self._manifest
                n = m.superseded_rows if tuple(marks) == m.superseded else m.deleted_rows
                gone = self._with_row_id(self._marked(marks), own).select("row_id")
                gone = F.broadcast(gone) if 0 <= n <= MAX_BROADCAST_MARKS else gone
                part = part.join(gone, "row_id", "left_anti")
            part = pad(part, current, initial=True, keep=at)
            found = part if found is None else found.unionByName(part)
        return empty if found is None else found

    def operations(self, since: int = 0, until: int | None = None) -> DataFrame:
        """The log in ``(since, until]``; files outside are not opened."""
        if since < self._manifest.low_water:
            raise BelowRetentionError(since, self._manifest.low_water)
        files = [f for f in self._manifest.log if f.seq_max > since and (until is None or f.seq_min <= until)]
        return self._read(files).where(feed.in_window(since, until))

    def versions(self, as_of: int | None = None, files_in: tuple[bytes | None, bytes | None] = (None, None)) -> DataFrame:
        """Base rows and later operations, enough to resolve the state as of ``as_of``.

        ``files_in`` are encoded bounds; files whose keys lie outside are not opened.
        """
        m = self._manifest
        if as_of is not None and as_of < m.base_seq:
            if as_of < m.low_water:
                raise BelowRetentionError(as_of, m.low_water)
            old = [f for f in m.near(m.log, *files_in) if f.seq_min <= as_of]
            return self._read(old, m.deletions).where(F.col("seq") <= as_of)
        after = [f for f in m.near(m.pending, *files_in) if as_of is None or f.seq_min <= as_of]
        found = self._read(after, m.deletions).where(feed.in_window(m.base_seq, as_of))
        base = m.near(m.base, *files_in)
        return self._read(base, m.deletions).unionByName(found) if base else found

    def state(
        self,
        as_of: int | None = None,
        files_in: tuple[bytes | None, bytes | None] = (None, None),
        where: Column | None = None,
    ) -> DataFrame:
        """Live rows with the seq that wrote them; ``where`` is a condition on the key.

        No row is shuffled where each key is stored once, or all stored rows
        that are not the newest of their key are marked.
        """
        m, where = self._manifest, F.lit(True) if where is None else where
        if as_of is None or as_of >= self.read_seq():
            base, after = m.near(m.base, *files_in), m.near(m.pending, *files_in)
            live = None
            if not after and len({f.level for f in base}) <= 1:
                live = self._read(base, m.deletions)
            elif m.superseded_seq >= self.read_seq() and not m.deletions:
                live = self._read([*base, *after], m.superseded)
            if live is not None:
                return live.where(where & (F.col("op") == resolve.PUT)).drop("op")
        return resolve.current_state(self.versions(as_of, files_in).where(where), self.pk, as_of)

    def scan(
        self,
        start: Sequence[Any] | None = None,
        end: Sequence[Any] | None = None,
        as_of: int | None = None,
        ordered: bool = True,
    ) -> DataFrame:
        """Live rows with ``start <= key < end``, in key order."""
        self._count("scans")
        start, end = (None if x is None else tuple(x) if isinstance(x, tuple | list) else (x,) for x in (start, end))
        bounds = tuple(None if x is None else encode(self.schema, x) for x in (start, end))
        found = self.state(as_of, bounds, resolve.in_range(self.pk, start, end)).select(*self.schema.names)
        return found.orderBy(*resolve.key_order(found, self.pk)) if ordered else found

    def scan_file(self, path: str, start: Sequence[Any] | None = None, end: Sequence[Any] | None = None) -> DataFrame:
        """One stored file's newest operation of each key with ``start <= key < end``, deletions too, without marked rows."""
        own = [f for f in self._manifest.files if f.path == path]
        if not own:
            raise NotFoundError(path)
        rows = self._read(own, self._manifest.deletions, positions=True)
        return merge.file_scan(rows, self.pk, start, end).drop("file_path", "row_index")

    def get(self, *key: Any, as_of: int | None = None) -> Row | None:
        """The live row of a key, or None."""
        self._count("gets")
        encoded = encode(self.schema, key)
        found = self.state(as_of, (encoded, encoded), resolve.is_key(self.pk, key))
        return found.select(*self.schema.names).first()

    def changes(
        self, since: int = 0, until: int | None = None, discriminate: bool = True, split_every: int | None = None
    ) -> DataFrame:
        """The labelled change feed of ``(since, until]``, up to what is visible now."""
        m = self._manifest
        until = self.read_seq() if until is None else min(until, self.read_seq())
        if since < m.low_water:
            raise BelowRetentionError(since, m.low_water)
        if m.base_seq and since >= m.base_seq and "marked" not in m.properties:
            # the base tells what was live at its seq; only later log files are opened
            later = [f for f in m.log if f.seq_max > m.base_seq and f.seq_min <= until]
            history = self._read(m.base).unionByName(self._read(later).where(feed.in_window(m.base_seq, until)))
        else:
            # expire() leaves the state at the low water mark in the log
            history = self._read([f for f in m.log if f.seq_min <= until]).where(F.col("seq") <= until)
        return feed.change_feed(
            history, self.pk, since, until, discriminate, key_bytes=pk_bytes(self.schema),
            split_every=split_every or self.options.max_records_per_file,
        )

    def cursor(self, since: int = 0, discriminate: bool = True) -> feed.Cursor:
        return feed.Cursor(lambda s: self.changes(s, discriminate=discriminate), since)

    def create_changes_view(self, name: str, since: int = 0) -> None:
        """The feed after ``since`` as a temporary view for SQL."""
        self.changes(since).createOrReplaceTempView(name)

    # maintenance

    def flush(self) -> int:
        """Mark the stored rows that operations since the last flush replaced; how many.

        A batch is durable once its manifest is, so nothing waits to be written.
        Of each key that the new operations touch, all versions but the newest
        are found in the files whose keys they overlap.
        """
        self._writable()
        if self._manifest.superseded_seq >= self.read_seq():
            return 0
        with self.metrics.timed("flush_ms"):
            return self._mark_replaced()

    def _mark_replaced(self) -> int:
        m, upto = self._manifest, self.read_seq()
        new = [f for f in m.log if f.seq_max > m.superseded_seq]
        old = m.superseded if m.superseded_seq else ()
        stored = [*m.base, *m.pending]
        if m.superseded_seq and new:
            low, high = (bytes.fromhex(x) for x in (min(f.key_min for f in new), max(f.key_max for f in new)))
            stored = [*m.near(m.base, low, high), *m.near(m.pending, low, high)]
        if not m.superseded_seq:
            found = self._replaced(stored, 0, upto)
        elif m.base_seq <= m.marked_seq and not m.deletions:
            found = self._replaced(stored, m.marked_row_id, m.marked_seq)
        else:
            rows = self._placed_keys(stored)
            newest = resolve.newest(self._placed_keys(new).where(F.col("seq") > m.superseded_seq), self.pk)
            newest = newest.select(F.col("seq").alias("_n_seq"), *[F.col(k).alias(f"_n_{k}") for k in self.pk])
            older = resolve.same_key(rows, newest, self.pk, "_n_{}") & (rows["seq"] < newest["_n_seq"])
            found = rows.join(newest, older, "left_semi").select("file_path", "row_index")
            if old:
                found = merge.without_positions(found, self._marked(old))
        names = self._write_positions(found, "superseded")
        n = self._marked(names).count() if names else 0
        before = m.superseded_rows if old else 0
        self._publish(
            m.apply(
                superseded=(*old, *names) if n else old, superseded_seq=upto, superseded_rows=before + n,
                marked_seq=upto, marked_row_id=m.next_row_id,
            )
        )
        self._count("rows_marked", n)
        return n

    def _replaced(self, files: Sequence[DataFile], row_id: int, marked_seq: int) -> DataFrame:
        """(file_path, row_index) of the rows of ``files`` that are not the newest of their key and have no mark yet.

        Files whose row ids are below ``row_id`` were there at the last flush,
        which saw all operations up to ``marked_seq``; of a key's rows in them
        only the newest can be without a mark, and it is if no row that was
        merged since is newer.  So old rows are only aggregated, by a number for
        each position: neither they nor their marks are shuffled.
        """
        files = sorted(files, key=lambda f: (f.first_row_id or 0) >= row_id)
        before = sum((f.first_row_id or 0) < row_id for f in files)
        fresh, row = F.col("_at") >= F.lit(before << _ROW_BITS), F.lit((1 << _ROW_BITS) - 1)
        rows, by = self._numbered_keys(files), self.pk
        seq, last = F.col("seq"), lambda which, c: F.max_by(c, F.when(which, F.col("seq")))
        top = rows.groupBy(*resolve.key_columns(rows, by)).agg(
            last(fresh, F.col("_at")).alias("_fresh"), last(~fresh, F.col("_at")).alias("_old"),
            F.max(F.when(fresh, seq)).alias("_fresh_seq"), F.max(F.when(~fresh, seq)).alias("_old_seq"),
            F.max(F.when(fresh & (seq <= marked_seq), seq)).alias("_merged_seq"),
        )
        known = F.coalesce(F.col("_old_seq"), F.lit(0))
        stays = F.when(F.col("_fresh_seq") > known, F.col("_fresh"))
        goes = F.when((F.col("_fresh_seq") > known) & (known > F.coalesce(F.col("_merged_seq"), F.lit(0))), F.col("_old"))
        told = top.select(F.inline(F.array(F.struct(stays.alias("_at"), F.lit(1).alias("_stays")), F.struct(goes.alias("_at"), F.lit(0).alias("_stays")))))
        told = told.where("_at is not null").union(self._numbered_keys(files[before:], before).select("_at", F.lit(0)))
        found = told.groupBy("_at").agg(F.max("_stays").alias("_stays")).where("_stays = 0")
        paths = self._spark.createDataFrame([(i, f.path) for i, f in enumerate(files)], "_file int, file_path string")
        found = found.select(F.shiftright("_at", _ROW_BITS).cast("int").alias("_file"), F.col("_at").bitwiseAND(row).alias("row_index"))
        return found.join(F.broadcast(paths), "_file").select("file_path", "row_index")

    def merge(self) -> bool:
        """The merge that the levels need most, if any is over its limit; whether there was one."""
        self._writable()
        m = self._manifest
        found = picker.pick([*m.pending, *m.base], self.options.policy)
        if found is not None:
            self._merge(found)
        return found is not None

    def compact(self) -> bool:
        """Merge all that waits in the log, then whatever levels are over their limits; False if nothing was to do."""
        self._writable()
        for done in range(MAX_MERGES):
            m, policy = self._manifest, self.options.policy
            files = [*m.pending, *m.base]
            found = picker.choose(files, policy, 0) if m.pending else picker.pick(files, policy)
            if found is None:
                return done > 0
            self._merge(found)
        return True

    def _merge(self, picked: picker.Pick) -> None:
        """Merge a pick's inputs and overlaps into its output level; no other file is read or written.

        Log files stay for the feed.  A deletion stays while a deeper level may
        hold its key.
        """
        with self.metrics.timed("merge_ms"):
            self._merge_files(picked)

    def _merge_files(self, picked: picker.Pick) -> None:
        m, sources = self._manifest, [*picked.inputs, *picked.overlaps]
        drop = picked.drop_deletions or not picked.below
        kept = merge.compact(self._read(sources, m.deletions), self.pk, None, drop_deletions=drop)
        files = self._write_files(self._dealt(kept, sources), picked.output_level)
        base_seq = max(f.seq_max for f in picked.inputs) if picked.level == 0 else m.base_seq
        gone = [f.path for f in sources if f.level > 0]
        after = m.apply(add=files, remove=gone, base_seq=max(base_seq, m.base_seq))
        # what is marked in the files that went is not marked in the new ones
        if not after.pending and len({f.level for f in after.base}) <= 1:
            seq = self.read_seq()
            after = replace(after, superseded=(), superseded_rows=0, superseded_seq=seq, marked_seq=seq, marked_row_id=after.next_row_id)
        elif picked.level == 0:
            after = replace(after, superseded_seq=min(m.superseded_seq, after.base_seq))
        else:
            after = replace(after, superseded=(), superseded_rows=0, superseded_seq=0)
        self._publish(after)
        self.metrics.observe("merge_bytes", sum(f.bytes for f in sources))
        self._count("compactions")
        self._count("bytes_read_by_merges", sum(f.bytes for f in sources))
        self._count("bytes_written", sum(f.bytes for f in files))

    def _dealt(self, rows: DataFrame, sources: Sequence[DataFile]) -> DataFrame:
        """Rows dealt out by ranges of the key, for files of the size that the options ask for."""
        by_bytes = -(-sum(f.bytes for f in sources) // self.options.target_file_bytes)
        by_rows = -(-sum(f.rows for f in sources) // self.options.max_records_per_file)
        return rows.repartitionByRange(max(1, by_bytes, by_rows), *self.pk)

    def _publish(self, after: Manifest) -> None:
        snapshots.commit(self._store, after)
        self._manifest = after

    def expire(self, before: int) -> int:
        """Forget operations up to ``before``; how many files go.

        Only files that lie wholly below go, so the low water mark is the
        greatest that no file crosses.  In their place stay the rows that were
        live at the mark, for the labels and pre-images of what came later.
        Rows marked as deleted stay marked: the feed knows them, the state does not.
        """
        self._writable()
        m = self._manifest
        if before > self.read_seq():
            raise InvalidArgumentError(f"there is no operation {before} yet")
        mark = min([before, *(f.seq_min - 1 for f in m.log if f.seq_max > before)])
        gone = [f for f in m.log if f.seq_max <= mark]
        if not gone or mark <= m.low_water:
            return 0
        marked = None
        if m.deletions:
            state, marked = self._expired_state(gone)
        else:
            state = merge.compact(self._read(gone), self.pk, None, drop_deletions=True)
        files = self._write_files(self._dealt(state, gone), level=0)
        deletions = m.deletions
        if marked is not None and files:
            at = self._read(files, positions=True).join(marked, "seq", "left_semi").select("file_path", "row_index")
            deletions = (*deletions, *self._write_positions(at, "deletions"))
        rows = self._marked(deletions).count() if marked is not None else 0
        after = m.apply(add=files, remove=[f.path for f in gone], low_water=mark, deletions=deletions, deleted_rows=rows)
        if mark > m.base_seq:  # the new files have pending rows in them
            after = replace(after, superseded=(), superseded_rows=0, superseded_seq=0)
        self._publish(after)
        return len(gone)

    def _expired_state(self, gone: Sequence[DataFile]) -> tuple[DataFrame, DataFrame]:
        """The rows to keep of files that go, and the seqs of those that are marked.

        The feed goes by the newest operation of a key, the state by the newest
        that is not marked; where they differ both stay.
        """
        marks = self._marked(self._manifest.deletions).withColumn("_marked", F.lit(True))
        rows = self._read(gone, positions=True).join(marks, ["file_path", "row_index"], "left").drop("file_path", "row_index")
        puts = F.col("op") == resolve.PUT
        live, last = resolve.newest(rows.where("_marked is null"), self.pk).where(puts), resolve.newest(rows, self.pk)
        keys, hides = live.select(*[F.col(k).alias(f"_l_{k}") for k in self.pk]), last.where(~puts)
        hides = hides.join(keys, resolve.same_key(hides, keys, self.pk, "_l_{}"), "left_semi")
        kept = live.union(last.where(puts)).union(hides).dropDuplicates(["seq"])
        return kept.drop("_marked"), kept.where("_marked").select("seq")

    def vacuum(self, older_than_s: float | None = None) -> list[str]:
        """Delete files that the newest snapshot does not name and that are older than the grace period."""
        self._writable()
        age = self.options.grace_s if older_than_s is None else older_than_s
        live = self._manifest.everything
        for pinned in self._pins:
            live |= pinned
        limit, gone = (time.time() - age) * 1000, []
        for kind in ("log", "base", "deletions", "superseded"):
            for folder in self._store.folders(kind):
                for name, _ in self._store.list(folder):
                    if name.endswith(".parquet") and name not in live and self._store.modified_ms(name) <= limit:
                        self._store.delete(name)
                        gone.append(name)
        self._count("files_deleted", len(gone))
        return gone

    @contextmanager
    def pin(self) -> Iterator[Manifest]:
        """Keep the files of the snapshot that is current now from :meth:`vacuum`, however long a reader takes."""
        held = self._manifest
        files = frozenset(held.everything)
        self._pins[files] += 1
        try:
            yield held
        finally:
            self._pins[files] -= 1
            if not self._pins[files]:
                del self._pins[files]

    def mark_deleted(self, positions: DataFrame) -> int:
        """Leave out stored rows at (file_path, row_index) from all reads of the state; how many are marked in all.

        For writers that delete by position instead of by key.  Marks add up and
        never become fewer; the next merge writes them out.  The change feed
        stays what was written.
        """
        self._writable()
        m = self._manifest
        own = positions.select(_below_root(F.col("file_path")).alias("file_path"), "row_index").distinct()
        known = self._spark.createDataFrame([(f.path,) for f in m.files], "known string")
        if own.join(known, own["file_path"] == known["known"], "left_anti").limit(1).count():
            raise InvalidArgumentError("a position is in no file of the snapshot")
        names = self._write_positions(merge.union_positions(self._marked(m.deletions), own), "deletions")
        # a base merged from now on lacks rows that the feed still has to know
        n = self._marked(names).count()
        self._publish(m.apply(deletions=names, deleted_rows=n, properties=m.properties | {"marked": "true"}))
        return n

    def _write_positions(self, positions: DataFrame, kind: str) -> tuple[str, ...]:
        folder = f"{kind}/{uuid.uuid4().hex}"
        positions.write.parquet(self._store.url(folder))
        return tuple(n for n, _ in self._store.list(folder) if n.endswith(".parquet"))

    def _marked(self, names: Sequence[str]) -> DataFrame:
        """The positions in files of marks; paths are below the table's root."""
        schema = "file_path string, row_index long"
        if not names:
            return self._spark.createDataFrame([], schema)
        found = self._spark.read.schema(schema).parquet(*[self._store.url(n) for n in names])
        return found.withColumn("file_path", _below_root(F.col("file_path")))

    def _with_row_id(self, rows: DataFrame, files: Sequence[DataFile]) -> DataFrame:
        """The rows that are in ``files`` with their row ids: the file's first and the number of the row in it."""
        first = self._spark.createDataFrame([(f.path, f.first_row_id) for f in files], "file_path string, first_row_id long")
        if len(files) <= MAX_BROADCAST_FILES:
            first = F.broadcast(first)
        return merge.lineage(rows, first).drop("first_row_id")

    def _placed_keys(self, files: Sequence[DataFile]) -> DataFrame:
        """seq, op, the key, and the position of every row of the files; nothing else is read."""
        struct = T.StructType([f for f in self.schema.log_struct() if f.name in ("seq", "op", *self.pk)])
        if not files:
            return self._spark.createDataFrame([], struct.add("file_path", "string").add("row_index", "long"))
        return _placed(self._spark.read.schema(struct).parquet(*[self._store.url(f.path) for f in files]), files)

    def _numbered_keys(self, files: Sequence[DataFile], first: int = 0) -> DataFrame:
        """seq, the key, and ``_at``, a number for the position of every row: the file's place in ``files`` and the row's number in it."""
        struct = T.StructType([f for f in self.schema.log_struct() if f.name in ("seq", *self.pk)])
        if not files:
            return self._spark.createDataFrame([], struct.add("_at", "long"))
        names, path = [f.path.rpartition("/")[2] for f in files], F.col("_metadata.file_name")
        if len(set(names)) < len(files):
            names, path = [f.path for f in files], _below_root(F.col("_metadata.file_path"))
        numbers = [(n, i << _ROW_BITS) for i, n in enumerate(names, first)]
        numbers = F.broadcast(self._spark.createDataFrame(numbers, "_name string, _first long"))
        rows = self._spark.read.schema(struct).parquet(*[self._store.url(f.path) for f in files])
        rows = rows.select("*", path.alias("_name"), F.col("_metadata.row_index").alias("_row"))
        return rows.join(numbers, "_name").select("seq", *self.pk, (F.col("_first") + F.col("_row")).alias("_at"))

    def refresh(self) -> None:
        """Go on from the newest snapshot; its files must all be there."""
        found = snapshots.load(self._store)
        have = {name for folder in {f.rpartition("/")[0] for f in found.everything} for name, _ in self._store.list(folder)}
        if missing := found.everything - have:
            raise NotFoundError(min(missing))
        self._manifest = found

    def add_column(self, new: ColumnSpec) -> TableSchema:
        """Add a column at the end; rows written before read as its initial default."""
        self._writable()
        after = self._manifest.apply(schema=self.schema.add(new))
        snapshots.commit(self._store, after)
        self._manifest = after
        return self.schema

    def superseded_positions(self) -> DataFrame:
        """(file_path, row_index) of every log row that is not the newest of its key."""
        return merge.replaced(self._placed_keys(self._manifest.log), self.pk)

    def marked_positions(self) -> DataFrame:
        """(file_path, row_index) of the stored rows that :meth:`flush` has marked."""
        return self._marked(self._manifest.superseded)

    def stats(self) -> dict[str, Any]:
        m = self._manifest
        levels: dict[int, dict[str, int]] = {}
        for f in m.files:
            at = levels.setdefault(f.level, {"files": 0, "bytes": 0, "rows": 0, "live_rows": 0})
            for k, v in (("files", 1), ("bytes", f.bytes), ("rows", f.rows), ("live_rows", f.live_rows)):
                at[k] += v
        return {
            "snapshot_id": m.snapshot_id, "read_seq": self.read_seq(), "base_seq": m.base_seq,
            "low_water": m.low_water, "schema_id": m.schema.schema_id, "levels": levels,
        }

    def file_table(self) -> DataFrame:
        """The snapshot's files as a table."""
        rows = [(f.path, f.level, f.rows, f.live_rows, f.bytes, f.seq_min, f.seq_max, f.key_min, f.key_max, f.first_row_id) for f in self._manifest.files]
        return self._spark.createDataFrame(
            rows,
            "path string, level int, rows long, live_rows long, bytes long, seq_min long, seq_max long, "
            "key_min string, key_max string, first_row_id long",
        )

    def level_table(self) -> DataFrame:
        return level_stats(self.file_table())

    def export(self, path: str) -> str:
        """The live rows as plain Parquet with a description of the table; see :mod:`tidelog.sources.export`."""
        from tidelog.sources.export import export_snapshot

        return export_snapshot(self, path)

