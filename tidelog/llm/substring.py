"""Substring dedup: Rabin-Karp hashes of every 35-word window, counted in Spark.

A window whose word sequence also starts anywhere else, in this document or
another, is repeated; the words that repeated windows cover go, as maximal
intervals.  Windows are judged on the input.

Shuffling a hash for every window would move several times the input, so
windows are counted in runs first.  A window's anchor is the leftmost least of
the mixed Rabin-Karp hashes of the 8-word grams inside it; neighbouring windows
with the same anchor at the same place are a run, and a run travels as its
anchor and one Rabin-Karp hash (two bases) of all its words:

* an anchor that occurs once has no repeated window;
* runs of the same words are repeated throughout, window by window;
* only where runs on one anchor differ do their windows travel one by one, one
  run of each kind, and are counted by their own hashes.

This counts every window exactly.  An anchor is a function of the window's words
alone, so equal windows have equal anchors, and a repeated window lies in two
runs on one anchor.  If these runs have the same words, the window is at the
same place in both, since the anchor's gram is the leftmost least of each window
and so at one place in the run; both runs are then counted as equal, and every
window in them is repeated.  If they differ, the anchor has runs that differ,
and the windows of one run of each kind are counted by hash; a window in a kind
that occurs twice is repeated anyway.  Conversely two windows only count as one
where all 128 bits of their hashes agree.

Skew.  A gram that very many documents share in different surroundings would
gather its runs in one task.  Such anchors show in a sample of the documents:
those with more than ``max_rows`` runs by that estimate, and of these the
:data:`MAX_HOT` most frequent, travel to the tasks.  A window on one of them is a run of its own whose anchor is a
hash of all its words.  Which anchors are so refined decides where windows are
counted, never which are repeated: equal windows still have equal anchors.
Rows that agree within a task are counted there, in blocks of :data:`BLOCK`:
the first carries the count, the others are proven and spread over all tasks, so
a passage that a third of the documents share brings a row for each block.
Null, empty and short texts, of which very many may be the same, are never dealt
out; longer rows of one doc_id and one text meet where the text is cut.

Defined results: null and empty texts have no words; texts of fewer than 35
words lose nothing; texts of any length are cut whole; rows that repeat are
copies of each other; null and repeated doc_ids are handled like others; a window
that overlaps its own copy counts as repeated; an empty table gives an empty
one; :func:`remove_repeats` keeps all rows and columns of the input, whatever
their names, and :func:`digest` reads no others than doc_id and text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import byte_texts, map_arrow, materialize, small_batches

WINDOW = 35
GRAM = 8
MEMORY = 200_000
#: Rows of a task in which equal ones are counted before they are shuffled.
BLOCK = 400_000
#: An anchor that seems to have more runs has its windows counted one by one.
MAX_ROWS = 50_000
#: One document in so many is looked at to find such anchors, of which there are no more than MAX_HOT.
SAMPLE = 64
MAX_HOT = 100_000

#: Odd multipliers of the rolling hashes modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 3)
        return value


class RollingHash:
    """Hashes of all windows of a sequence, from prefix sums of codes times inverse powers."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", self.inverse)):
                steps = np.full(n, b, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def __call__(self, codes: np.ndarray, width: int) -> np.ndarray:
        n = len(codes) - width + 1
        if n < 1:
            return np.empty(0, np.uint64)
        begin = np.arange(n)
        return self.spans(codes, begin, begin + width)

    def spans(self, codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the spans [begin, end)."""
        self._grow(len(codes) + 1)
        prefix = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * self.down[: len(codes)], out=prefix[1:])
        return (prefix[end] - prefix[begin]) * self.up[end - 1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def anchors(codes: np.ndarray, roll: RollingHash, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Position and value of the anchor of each window: the leftmost least gram."""
    grams = _mix(roll(codes, gram))
    span = window - gram + 1
    n = len(codes) - window + 1
    # doubling: the least of `done` grams from each place, and where it is, the leftmost on ties
    low, at, done = grams, np.arange(len(grams)), 1
    while done < span:
        step = min(done, span - done)
        a, b = low[: len(low) - step], low[step:]
        take = b < a
        at = np.where(take, at[step:], at[: len(at) - step])
        low = np.where(take, b, a)
        done += step
    return at[:n], low[:n]


def _key() -> Column:
    """With doc_id, tells rows apart unless they repeat."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _may_repeat(window: int) -> Column:
    """Whether a text is long enough for a window: so many words and the space between them."""
    return F.coalesce(F.length(F.col("text").cast("string")) >= 2 * window - 1, F.lit(False))


def _no_spans() -> Column:
    return F.lit(None).cast("array<struct<start:int,n:int>>").alias("spans")


def _plain(docs: DataFrame, name: str, type: T.DataType) -> Column:
    """A column as that type.  One that is of it already is not named anew, so that plans that read it stay the same."""
    return F.col(name) if docs.schema[name].dataType == type else F.col(name).cast(type).alias(name)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(_plain(docs, "doc_id", T.LongType()), _key().alias("key"), _plain(docs, "text", T.StringType()))


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["key"] == b["key"])


def _counted_here(*keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Counts equal rows of a block before they are shuffled: the keys, and the count of each row.

    The first of equal rows carries their count.  The others are proven
    repeated; they get keys of their own, spread evenly, and the count 2.
    """
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        x = k[order]
        new[1:] |= x[1:] != x[:-1]
    starts = np.flatnonzero(new)
    n = np.full(len(order), 2, np.int64)
    n[order[starts]] = np.diff(np.append(starts, len(order)))
    rest, found = order[~new], []
    salt = np.arange(len(rest), dtype=np.uint64) * np.uint64(BASES[1])
    for i, k in enumerate(keys):
        k = k.copy()
        k[rest] = _mix(k[rest] + salt * np.uint64(2 * i + 1))
        found.append(k)
    return found, n


def _codes(words: list[bytes], memory: _Codes) -> np.ndarray:
    return np.fromiter(map(memory.__getitem__, words), np.uint64, len(words))


class _Blocks:
    """Gathers the rows of a task's batches, and counts equal ones in blocks of about :data:`BLOCK`."""

    def __init__(self, names: list[str], keys: list[str]):
        self.names, self.keys, self.held, self.rows = names, keys, [], 0

    def add(self, ids: pa.RecordBatch, owner: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows = pa.array(owner)
        found = [ids.column(c).take(rows) for c in ("doc_id", "key")] + [pa.array(c) for c in columns]
        self.held.append(pa.RecordBatch.from_arrays(found, names=["doc_id", "key", *self.names]))
        self.rows += len(owner)
        if self.rows >= BLOCK:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        block = pa.Table.from_batches(self.held).combine_chunks()
        self.held, self.rows = [], 0
        keys, count = _counted_here(*[block.column(k).to_numpy().astype(np.uint64) for k in self.keys])
        for k, x in zip(self.keys, keys, strict=True):
            block = block.set_column(block.column_names.index(k), k, pa.array(x.view(np.int64)))
        yield from block.append_column("count", pa.array(count)).to_batches(max_chunksize=50_000)


def _runs(codes: np.ndarray, rolls: list[RollingHash], window: int, gram: int, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """Start, how many windows, anchor and both hashes of each run; windows on the sorted anchors ``hot`` are runs of one."""
    at, value = anchors(codes, rolls[0], window, gram)
    cut = at[1:] != at[:-1]
    if len(hot):
        single = hot[np.minimum(np.searchsorted(hot, value), len(hot) - 1)] == value
        cut |= single[1:]
    begin = np.flatnonzero(np.concatenate([[True], cut]))
    n = np.diff(np.append(begin, len(at)))
    one, two = (r.spans(codes, begin, begin + n + window - 1) for r in rolls)
    anchor = value[begin]
    if len(hot):
        own = single[begin]
        anchor[own] = _mix(one[own] ^ _mix(two[own]))
    return begin, n, anchor, one, two


def _run_rows(keyed: DataFrame, window: int, gram: int, hot: np.ndarray) -> DataFrame:
    """doc_id, key, start, n, anchor, h1, h2 and count of the runs of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, rolls = _Codes(), [RollingHash(b) for b in BASES]
        blocks = _Blocks(["start", "n", "anchor", "h1", "h2"], ["anchor", "h1", "h2"])
        for batch in batches:
            found: list[list[np.ndarray]] = [[] for _ in range(6)]
            for first, texts in byte_texts(batch):
                for i, text in enumerate(texts, first):
                    words = (text or b"").split()
                    if len(words) >= window:
                        own = _runs(_codes(words, memory), rolls, window, gram, hot)
                        for part, x in zip(found, (np.full(len(own[0]), i), *own), strict=True):
                            part.append(x)
            if found[0]:
                owner, begin, n, anchor, one, two = (np.concatenate(x) for x in found)
                yield from blocks.add(batch, owner, begin.astype(np.int32), n.astype(np.int32), anchor, one, two)
        yield from blocks.flush()

    small_batches(keyed.sparkSession)
    return keyed.mapInArrow(run, "doc_id long, key long, start int, n int, anchor long, h1 long, h2 long, count long")


def _hot_anchors(keyed: DataFrame, window: int, gram: int, max_rows: int, sample: int) -> np.ndarray:
    """Anchors that seem to have more than ``max_rows`` runs, in order; at most :data:`MAX_HOT`."""
    some = _run_rows(keyed.sample(1 / sample, seed=7) if sample > 1 else keyed, window, gram, np.empty(0, np.uint64))
    seen = some.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > max_rows / sample)
    found = [r[0] for r in seen.orderBy(F.desc("n"), "anchor").limit(MAX_HOT).collect()]
    return np.sort(np.array(found, np.int64).view(np.uint64))


def repeated_spans(
    keyed: DataFrame, window: int = WINDOW, gram: int = GRAM, max_rows: int = MAX_ROWS, sample: int = SAMPLE
) -> DataFrame:
    """doc_id, key and ``spans`` of every document that has repeated windows.

    A span (start, n) stands for the n windows that begin at the words start, start + 1, ...
    ``keyed`` has doc_id, key and text.
    """

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, rolls = _Codes(), [RollingHash(b) for b in BASES]
        blocks = _Blocks(["start", "single", "h1", "h2"], ["h1", "h2"])
        for batch in batches:
            lists = batch.column("runs")
            for first, texts in byte_texts(batch):
                found: list[list[np.ndarray]] = [[] for _ in range(5)]
                for i, text in enumerate(texts, first):
                    codes = _codes((text or b"").split(), memory)
                    start, n, single = (lists[i].values.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                    s = np.concatenate([np.arange(a, a + k) for a, k in zip(start.tolist(), n.tolist(), strict=True)])
                    hashes = [r.spans(codes, s, s + window) for r in rolls]
                    for part, x in zip(found, (np.full(len(s), i), s, np.repeat(single, n), *hashes), strict=True):
                        part.append(x)
                owner, start, single, one, two = (np.concatenate(x) for x in found)
                yield from blocks.add(batch, owner, start.astype(np.int32), single.astype(bool), one, two)
        yield from blocks.flush()

    rows = _run_rows(keyed, window, gram, _hot_anchors(keyed, window, gram, max_rows, sample))
    same, kind = W.partitionBy("anchor"), W.partitionBy("anchor", "h1", "h2")
    counted = rows.select(
        "doc_id", "key", "start", "n",
        F.sum("count").over(kind).alias("copies"),
        F.row_number().over(kind.orderBy("doc_id", "key", "start")).alias("rank"),
        F.sum("count").over(same).alias("all"),
        (F.min(F.struct("h1", "h2")).over(same) != F.max(F.struct("h1", "h2")).over(same)).alias("differ"),
    )
    shared = materialize(counted.where("all > 1").drop("all"), "runs")
    asked = (
        shared.where("differ and rank = 1")
        .groupBy("doc_id", "key")
        .agg(F.collect_set(F.struct("start", "n", (F.col("copies") == 1).alias("single"))).alias("runs"))
    )
    joined = keyed.join(asked, _same(keyed, asked)).select(keyed["doc_id"], keyed["key"], "text", "runs")
    each = joined.mapInArrow(windows, "doc_id long, key long, start int, single boolean, h1 long, h2 long, count long")
    times = each.withColumn("times", F.sum("count").over(W.partitionBy("h1", "h2"))).where("times > 1 and single")
    found = shared.where("copies > 1").select("doc_id", "key", "start", "n").union(
        times.select("doc_id", "key", "start", F.lit(1).alias("n"))
    )
    # a set: rows that repeat add nothing to it
    return found.groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "n")).alias("spans"))


def intervals(start: np.ndarray, n: np.ndarray, window: int = WINDOW) -> list[tuple[int, int]]:
    """Maximal intervals [start, end) of words that the spans' windows cover."""
    if not len(start):
        return []
    order = np.argsort(start, kind="stable")
    begin, end = start[order], np.maximum.accumulate((start + n + window - 1)[order])
    new = np.concatenate([[True], begin[1:] > end[:-1]])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(begin) - 1)
    return list(zip(begin[new].tolist(), end[last].tolist(), strict=True))


def _cut(lists: pa.ListArray, i: int, window: int) -> list[tuple[int, int]]:
    if not lists[i].is_valid:
        return []
    own = lists[i].values
    return intervals(*(own.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1)), window)


def digest(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, **skew) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document; ``skew`` is for :func:`repeated_spans`."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counts, removed, digests = [], [], []
        for first, texts in byte_texts(batch):
            for i, text in enumerate(texts, first):
                words = (text or b"").split()
                counts.append(len(words))
                cut = _cut(batch.column("spans"), i, window)
                for a, b in reversed(cut):
                    del words[a:b]
                removed.append(sum(b - a for a, b in cut))
                digests.append(sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests)],
            names=["doc_id", "n_words", "n_removed", "kept_sha256"],
        )

    # texts without a window, many of which may be the same, are never dealt out
    keyed = _keyed(docs.where(_may_repeat(window)))
    short = _keyed(docs.where(~_may_repeat(window)))
    spans = repeated_spans(keyed, window, gram, **skew)
    # the texts are dealt out once: this join and the one for the windows read the same exchange
    rows = keyed.join(spans, _same(keyed, spans), "left").select(keyed["doc_id"], "text", "spans")
    rows = rows.union(short.select("doc_id", "text", _no_spans()))
    return map_arrow(rows, run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def cut_text(text: bytes, cut: list[tuple[int, int]]) -> bytes:
    """The text without the words of the intervals and the white space after each interval's last word."""
    spans = [m.span() for m in _WORD.finditer(text)]
    parts, at = [], 0
    for a, b in cut:
        parts.append(text[at : spans[a][0]])
        at = spans[b][0] if b < len(spans) else len(text)
    return b"".join([*parts, text[at:]])


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """All rows and columns of ``docs``, ``text`` without its repeated passages and ``n_chars``, if there, its new length."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = []
        for first, texts in byte_texts(batch):
            for i, text in enumerate(texts, first):
                cut = _cut(batch.column("spans"), i, window)
                found.append(cut_text(text, cut) if cut and text is not None else text)
        column = pa.array(found, pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("row"), column], names=["row", "cut"])

    others = [c for c in docs.columns if c != "text"]
    every = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), _key().alias("key"), F.col("text").cast("string").alias("text"),
        F.struct(*others).alias("row"),
    )
    keyed, short = every.where(_may_repeat(window)), every.where(~_may_repeat(window))
    spans = repeated_spans(keyed, window, gram)
    judged = keyed.join(spans, _same(keyed, spans), "left").select("row", "text", "spans")
    judged = judged.union(short.select("row", "text", _no_spans()))
    schema = T.StructType([judged.schema["row"], T.StructField("cut", T.StringType())])
    done = map_arrow(judged, run, schema)
    columns = []
    for name in docs.columns:
        if name == "text":
            columns.append(F.col("cut").alias("text"))
        elif name == "n_chars":
            columns.append(F.length("cut").cast(docs.schema["n_chars"].dataType).alias("n_chars"))
        else:
            columns.append(F.col("row")[name].alias(name))
    return done.select(*columns)
