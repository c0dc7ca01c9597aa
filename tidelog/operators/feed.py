"""The change feed: every operation in ``(since, until]``, labelled, deletions with the row they removed.

A put is an UPDATE if its key was live just before, else an INSERT.  A deletion
returns the row that was live just before; if there was none, all columns are
null.  The feed depends on the log alone, not on how it is stored.

``lag`` by key must see the operation before ``since``, and a bound on ``seq``
does not pass through a window.  So the feed reads the operations in range, and
for their keys only the newest operation up to ``since``; the window runs over
those.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import islice

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.errors import BelowRetentionError
from tidelog.operators.resolve import DELETE, PUT, key_columns, newest

#: Operations of one key that a task works on at most.
SPLIT_EVERY = 5_000_000

INSERT_LABEL, UPDATE_LABEL, DELETE_LABEL = "INSERT", "UPDATE", "DELETE"


def in_window(since: int, until: int | None) -> Column:
    found = F.col("seq") > since
    return found if until is None else found & (F.col("seq") <= until)


def _prior(ops: DataFrame, pk: Sequence[str], delta: DataFrame, since: int) -> DataFrame:
    """The newest operation up to ``since`` of each key that the delta touches."""
    keys = delta.select(*pk).distinct()
    same = [ops[k].eqNullSafe(keys[k]) for k in pk]
    return newest(ops.where(F.col("seq") <= since).join(keys, same, "left_semi"), pk)


def with_previous(ops: DataFrame, pk: Sequence[str], split_every: int | None = None) -> DataFrame:
    """Adds ``_before``, the operation before each on its key, null for the first.

    With ``split_every`` a key's operations are worked on in ranges of so many
    seqs, in different tasks; each range's first operation takes the last of the
    ranges before.  That bounds what one very busy key brings to a task.
    """
    keys, columns = key_columns(ops, pk), [c for c in ops.columns]
    row = F.struct(*[F.col(c) for c in columns])
    if not split_every:
        return ops.withColumn("_before", F.lag(row).over(W.partitionBy(*keys).orderBy("seq")))
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    by = [f"_k{i}" for i in range(len(keys))]
    cut = ops.select("*", *named, F.floor(F.col("seq") / split_every).alias("_part"))
    inside = cut.withColumn("_before", F.lag(row).over(W.partitionBy(*by, "_part").orderBy("seq")))
    last = cut.groupBy(*by, "_part").agg(F.max_by(row, "seq").alias("_last"))
    carried = last.select(
        *[F.col(k).alias(f"{k}r") for k in by],
        F.col("_part").alias("_partr"),
        F.lag("_last").over(W.partitionBy(*by).orderBy("_part")).alias("_carried"),
    )
    same = [inside[k].eqNullSafe(carried[f"{k}r"]) for k in by] + [inside["_part"] == carried["_partr"]]
    return inside.join(carried, same, "left").select(
        *columns, F.coalesce("_before", "_carried").alias("_before")
    )


def change_feed(
    ops: DataFrame,
    pk: Sequence[str],
    since: int = 0,
    until: int | None = None,
    discriminate: bool = True,
    low_water: int = 0,
    key_bytes: Column | None = None,
    split_every: int | None = SPLIT_EVERY,
) -> DataFrame:
    """``seq``, ``op`` (a label), ``pk_bytes`` if an expression for it is given, and the row's columns.

    Without ``discriminate`` every put is an INSERT and nothing is looked up for
    it; deletions still carry the row they removed.  Rows are not ordered.  A key
    brings at most ``split_every`` operations to a task; a range that is known to
    be no longer needs no splitting.
    """
    if since < low_water:
        raise BelowRetentionError(since, low_water)
    columns = [c for c in ops.columns if c not in ("seq", "op")]
    keys = [] if key_bytes is None else [key_bytes.alias("pk_bytes")]
    delta = ops.where(in_window(since, until))
    seen = delta if since <= 0 else delta.unionByName(_prior(ops, pk, delta, since))
    if until is not None and split_every and until - since <= split_every:
        split_every = None
    ranked = with_previous(seen, pk, split_every)
    live = F.coalesce(F.col("_before.op") == PUT, F.lit(False))
    put = F.when(live, UPDATE_LABEL).otherwise(INSERT_LABEL) if discriminate else F.lit(INSERT_LABEL)
    deletes = F.col("op") == DELETE
    return ranked.where(F.col("seq") > since).select(
        "seq",
        F.when(deletes, DELETE_LABEL).otherwise(put).alias("op"),
        *keys,
        *[F.when(~deletes, F.col(c)).when(live, F.col(f"_before.{c}")).alias(c) for c in columns],
    )


def labels_only(ops: DataFrame, since: int = 0, until: int | None = None) -> DataFrame:
    """The cheapest feed: no look-up at all, every put an INSERT, a deletion with null columns."""
    columns = [c for c in ops.columns if c not in ("seq", "op")]
    deletes = F.col("op") == DELETE
    return ops.where(in_window(since, until)).select(
        "seq",
        F.when(deletes, DELETE_LABEL).otherwise(INSERT_LABEL).alias("op"),
        *[F.when(~deletes, F.col(c)).alias(c) for c in columns],
    )


class Cursor:
    """Reads a feed page by page, in order of ``seq``, and remembers where it is.

    The first pages come from a scan that keeps only them.  For a reader that
    goes on, the rest is sorted once and handed over a partition at a time, so
    the number of scans does not grow with the number of pages.  What is written
    meanwhile is found by a new scan at the end of the last.
    """

    def __init__(self, feed, since: int = 0):
        """``feed`` makes the feed after a seq: ``feed(since) -> DataFrame``."""
        self._feed, self._since, self._held, self._rest = feed, since, [], None

    @property
    def since_seq(self) -> int:
        return self._since

    def buffered_len(self) -> int:
        return len(self._held)

    def _after(self, since: int, first: int) -> Iterator[Row]:
        found = self._feed(since).orderBy("seq").limit(first).collect()
        yield from found
        if len(found) == first:
            yield from self._feed(found[-1]["seq"]).orderBy("seq").toLocalIterator(prefetchPartitions=True)

    def next_batch(self, max_rows: int) -> list:
        """Up to ``max_rows`` rows after the last returned; none at the head of the feed."""
        if max_rows < 1:
            return []
        want = max(4 * max_rows, 1024)  # one fetch fills several pages
        if not self._held and self._rest is None:
            self._rest = self._after(self._since, want)
        if len(self._held) < max_rows and self._rest is not None:
            more = list(islice(self._rest, want))
            self._held += more
            if len(more) < want:
                self._rest = None
        page, self._held = self._held[:max_rows], self._held[max_rows:]
        if page:
            self._since = page[-1]["seq"]
        return page
