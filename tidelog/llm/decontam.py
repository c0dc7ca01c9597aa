"""Benchmark decontamination: size-partitioned MinHash containment search.

Documents and items are sets of five-word shingles of the lower-cased text; an
item of fewer words is one shingle, all of its words, and documents are then
looked at in shingles of that width as well.  A document holds an item if it
contains at least ``threshold`` of the item's shingles.  Items are much smaller
than documents, so Jaccard similarity says little; instead

* items are partitioned by size, the partition being the shingles' width and
  the bit length of their count;
* an item's sketch is its ``k`` smallest MinHash values, with ``k`` one more
  than the number of shingles that may be missing at the threshold.  Whatever
  is missing, one of the ``k`` is in a document that holds the item, so the
  search loses nothing;
* a document's sketch for a partition is all its MinHash values up to the
  largest in that partition's item sketches, and is empty if the document is
  too small to hold any item of the partition;
* sketches that share a value give candidates, and each candidate is verified
  by exact containment of its shingles, word by word.

Items of proven small size travel to the tasks.  A larger benchmark is joined to
the document sketches by value, after a bitmap of its values, of at most
``2 ** MAX_BITS`` bits, has taken out nearly all that meet nothing; candidates
then meet their documents by a hash of doc_id and text.  Both ways judge each
row by its own text and give the same rows.

Defined results: null and empty texts, and those of white space, hold nothing
and are held by nothing; equal items are verified once and each get their rows,
items without an id too; repeated document rows each get theirs, whatever other
texts their doc_id has, and rows without a doc_id are told apart by their texts;
texts of any length are searched whole; containment of exactly the threshold
counts; an empty table on either side finds nothing; further columns, whatever
their names, are ignored by :func:`search` and kept by :func:`filter_contaminated`.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import CHUNK_ROWS, map_arrow, materialize, small_batches

WORDS = 5
THRESHOLD = 0.8
#: A benchmark of at most so many items and bytes travels to the tasks.
MAX_ITEMS, MAX_BYTES = 20_000, 16_000_000
#: The bitmap of a larger benchmark's sketch values has at most two to this many bits.
MAX_BITS = 26
MEMORY = 200_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 17)
        return value


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").split()


def width_of(words: list[bytes]) -> int:
    """How many words an item's shingles have; 0 for an item without words."""
    return min(WORDS, len(words))


def min_hashes(words: list[bytes], memory: dict, width: int = WORDS) -> np.ndarray:
    """The hash of every shingle, in order; uniform over 64 bits, and another for each width."""
    n = len(words) - width + 1
    if n < 1 or width < 1:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(memory.__getitem__, words), np.uint64, len(words))
    h = np.full(n, WORDS - width, np.uint64)
    for i in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def shingles(words: list[bytes], width: int = WORDS) -> set[tuple[bytes, ...]]:
    return set(zip(*(words[i:] for i in range(width)), strict=False))


def needed(size: int, threshold: float) -> int:
    """The least number of an item's ``size`` shingles that a holder contains."""
    return max(1, int(np.ceil(threshold * size - 1e-9)))


def sketch(hashes: np.ndarray, threshold: float) -> np.ndarray:
    distinct = np.unique(hashes)
    return distinct[: len(distinct) - needed(len(distinct), threshold) + 1]


@dataclass
class Partition:
    """Items of one width and size class: their sketch values in order, and the items behind each."""

    width: int
    least: int
    values: np.ndarray
    items: list[list[int]]


def partitions(texts: list[str | None], threshold: float) -> tuple[list[Partition], list[tuple[int, set[tuple[bytes, ...]]]]]:
    """The size partitions, and the width and the shingles of each item."""
    memory, by_class, exact = _WordHashes(), defaultdict(lambda: (defaultdict(list), [])), []
    for i, text in enumerate(texts):
        words = words_of(text)
        width = width_of(words)
        own = shingles(words, width)
        exact.append((width, own))
        if own:
            posts, sizes = by_class[width, len(own).bit_length()]
            sizes.append(needed(len(own), threshold))
            for v in sketch(min_hashes(words, memory, width), threshold).tolist():
                posts[v].append(i)
    found = []
    for (width, _), (posts, sizes) in sorted(by_class.items()):
        values = np.array(sorted(posts), np.uint64)
        found.append(Partition(width, min(sizes), values, [posts[v] for v in values.tolist()]))
    return found, exact


def candidates(hashes: dict[int, np.ndarray], parts: list[Partition]) -> set[int]:
    """Items that share a sketch value with a document, from its hashes of each width."""
    found: set[int] = set()
    for part in parts:
        every = hashes[part.width]
        if len(every) < part.least:
            continue
        own = every[every <= part.values[-1]]
        at = np.searchsorted(part.values, own)
        for k in np.unique(at[part.values[at] == own]).tolist():
            found.update(part.items[k])
    return found


class _Searcher:
    def __init__(self, item_texts: list[str | None], threshold: float):
        self.parts, self.exact = partitions(item_texts, threshold)
        self.widths = sorted({p.width for p in self.parts})
        self.threshold, self.memory = threshold, _WordHashes()

    def __call__(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item, its shingles, those that the text contains) of each item that the text holds."""
        words = words_of(text)
        near = candidates({w: min_hashes(words, self.memory, w) for w in self.widths}, self.parts)
        if not near:
            return []
        own, found = {w: shingles(words, w) for w in {self.exact[i][0] for i in near}}, []
        for i in sorted(near):
            width, mine = self.exact[i]
            size, shared = len(mine), len(mine & own[width])
            if shared >= needed(size, self.threshold):
                found.append((i, size, shared))
        return found


_searchers: dict[str, _Searcher] = {}


def searcher(item_texts: list[str | None], threshold: float, digest: str) -> _Searcher:
    """The index of a small benchmark, built once a Python worker."""
    if digest not in _searchers:
        _searchers.clear()
        _searchers[digest] = _Searcher(item_texts, threshold)
    return _searchers[digest]


def _digest(item_texts: list[str | None], threshold: float) -> str:
    return sha256(repr((item_texts, threshold)).encode("utf-8", "replace")).hexdigest()


_SCHEMA = "doc_id long, item_id long, n_item_shingles long, n_shared long, containment double"


def _small(items: DataFrame, max_items: int, max_bytes: int) -> list | None:
    """The items, if there are few enough to travel."""
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    if n > max_items or size > max_bytes:
        return None
    return items.orderBy("item_id", "text").collect()


def search(
    docs: DataFrame,
    benchmark: DataFrame,
    threshold: float = THRESHOLD,
    max_items: int = MAX_ITEMS,
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """One row per document and item that it holds."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    small = _small(items, max_items, max_bytes)
    if small is None:
        return _search_joined(docs, items, threshold)
    ids, texts = [r[0] for r in small], [r[1] for r in small]
    digest = _digest(texts, threshold)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        find, rows = searcher(texts, threshold, digest), []
        for at in range(0, batch.num_rows, CHUNK_ROWS):
            part = batch.slice(at, CHUNK_ROWS)
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                rows += [(doc_id, ids[i], size, shared, shared / size) for i, size, shared in find(text)]
        yield _rows(rows)

    return map_arrow(docs, run, _SCHEMA)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    kinds = [pa.int64()] * 4 + [pa.float64()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
        names=["doc_id", "item_id", "n_item_shingles", "n_shared", "containment"],
    )


def _key(id_name: str, text_name: str = "text") -> Column:
    """Tells rows apart unless they repeat; where it does not, a row only gets more candidates to verify."""
    return F.xxhash64(F.col(id_name).cast("long"), F.col(text_name).cast("string"))


def _bitmap(values: DataFrame) -> np.ndarray:
    """Which low bits the sketch values have, 64 to a word: about 16 bits a value, 2 ** MAX_BITS at most."""
    n = values.count()
    bits = min(max(int(16 * n).bit_length(), 10), MAX_BITS)
    at = F.col("value").bitwiseAND(F.lit((1 << bits) - 1))
    one = F.expr("shiftleft(1L, int(value & 63L))")
    words = values.select(F.shiftright(at, 6).alias("word"), one.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    got = words.toPandas()  # bounded: one row for 64 bits
    found = np.zeros(1 << (bits - 6), np.uint64)
    found[got.word.to_numpy(np.int64)] = got.bits.to_numpy(np.int64).view(np.uint64)
    return found


def _among(hashes: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """The hashes whose bit is set."""
    at = hashes & np.uint64(64 * len(bitmap) - 1)
    return hashes[(bitmap[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)]


def _item_key() -> Column:
    return F.md5(F.col("text").cast("binary"))


def _near_items(docs: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """The candidates of each ``key`` of ``docs``, for a benchmark of any size: sketches meet in a join by value.

    A candidate is a text with its ``item_key``, however many items have it.
    """
    texts = items.where("text is not null").select("text").distinct().withColumn("item_key", _item_key())

    def sketches(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        memory, rows = _WordHashes(), []
        for item_key, text in zip(batch.column("item_key").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words = words_of(text)
            h = min_hashes(words, memory, width_of(words))
            if len(h):
                least = needed(len(np.unique(h)), threshold)
                rows += [(item_key, width_of(words), least, v) for v in sketch(h, threshold).view(np.int64).tolist()]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["item_key", "width", "least", "value"]
        )

    own = materialize(map_arrow(texts, sketches, "item_key string, width int, least long, value long"), "sketches")
    widths = sorted(r[0] for r in own.select("width").distinct().collect())  # five at most
    bitmap = _bitmap(own.select("value").distinct())

    def values(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        memory = _WordHashes()
        for at in range(0, batch.num_rows, CHUNK_ROWS):
            part, keys, sizes, found = batch.slice(at, CHUNK_ROWS), [], [], []
            for key, text in zip(part.column("key").to_pylist(), part.column("text").to_pylist(), strict=True):
                words = words_of(text)
                for width in widths:
                    h = min_hashes(words, memory, width)
                    v = _among(np.unique(h), bitmap).view(np.int64)
                    keys += [key] * len(v)
                    sizes.append(np.full(len(v), len(h)))
                    found.append(v)
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(found))],
                    names=["key", "size", "value"],
                )

    met = map_arrow(docs, values, "key long, size long, value long").join(own, "value").where("size >= least")
    near = (
        met.select("key", "item_key")
        .distinct()
        .join(texts.select("item_key", F.col("text").alias("item_text")), "item_key")
        .groupBy("key")
        .agg(F.collect_list(F.struct("item_key", "item_text")).alias("near"))
    )
    return materialize(near, "near")  # so that Spark can split a key that very many rows have


def _held(text: str | None, near: list[dict] | None, threshold: float) -> Iterator[tuple[str, int, int]]:
    """(item_key, its shingles, those that the text contains) of each candidate that the text holds."""
    words, own = words_of(text) if near else [], {}
    for item in near or []:
        theirs = words_of(item["item_text"])
        width = width_of(theirs)
        if width not in own:
            own[width] = shingles(words, width)
        mine = shingles(theirs, width)
        shared = len(mine & own[width])
        if mine and shared >= needed(len(mine), threshold):
            yield item["item_key"], len(mine), shared


def _search_joined(docs: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """The search for a benchmark of any size: candidates meet their documents in a join, and are verified there."""
    keyed = docs.withColumn("key", _key("doc_id"))

    def verify(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for doc_id, text, near in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "near")), strict=True):
            rows += [(doc_id, i, size, shared) for i, size, shared in _held(text, near, threshold)]
        columns, kinds = list(zip(*rows, strict=True)) or [[]] * 4, [pa.int64(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_key", "n_item_shingles", "n_shared"]
        )

    joined = keyed.join(_near_items(keyed, items, threshold), "key").select("doc_id", "text", "near")
    found = map_arrow(joined, verify, "doc_id long, item_key string, n_item_shingles long, n_shared long")
    named = items.where("text is not null").select("item_id", _item_key().alias("item_key"))
    return found.join(named, "item_key").select(
        "doc_id", "item_id", "n_item_shingles", "n_shared", (F.col("n_shared") / F.col("n_item_shingles")).alias("containment")
    )


def _filter_joined(docs: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """The filter for a benchmark of any size: each row meets its candidates, and goes only if its own text holds one."""
    names = docs.columns
    at_text = names.index("text")
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    keyed = plain.withColumn("key", _key(f"c{names.index('doc_id')}", f"c{at_text}"))
    near = _near_items(keyed.select("key", F.col(f"c{at_text}").cast("string").alias("text")), items, threshold)
    rows = keyed.join(near, "key", "left").drop("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = []
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.slice(at, CHUNK_ROWS)
                both = zip(part.column(at_text).to_pylist(), part.column(len(names)).to_pylist(), strict=True)
                clean += [not any(_held(text, near, threshold)) for text, near in both]
            if clean:
                yield batch.select(range(len(names))).filter(pa.array(clean))

    small_batches(docs.sparkSession)
    return rows.mapInArrow(run, plain.schema).toDF(*names)


def filter_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    threshold: float = THRESHOLD,
    max_items: int = MAX_ITEMS,
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    small = _small(items, max_items, max_bytes)
    names = docs.columns
    if small is None:
        return _filter_joined(docs, items, threshold)
    texts, at_text = [r[1] for r in small], names.index("text")
    digest = _digest(texts, threshold)
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                find = searcher(texts, threshold, digest)
                clean = []
                for at in range(0, batch.num_rows, CHUNK_ROWS):
                    clean += [not find(t) for t in batch.column(at_text).slice(at, CHUNK_ROWS).to_pylist()]
                yield batch.filter(pa.array(clean))

    small_batches(docs.sparkSession)
    return plain.mapInArrow(run, plain.schema).toDF(*names)
