"""SimHash near-dedup over a segment-popcount embedding.

A fingerprint of 64 bits is mapped to the bit counts of its 32 two-bit
segments.  The Manhattan distance of two such vectors never exceeds the Hamming
distance of the fingerprints, so links at ``<= 4`` differing bits are found by a
range join under Manhattan distance and verified exactly.

The range join runs on a grid.  If two vectors are within 4, then their first
halves are within 2 or their second halves within 1:

* halves within 2 have a common lattice point within 1 of both, so every vector
  enters the cells of its first half and of that half's neighbours;
* halves within 1 are equal or differ in parity, so a vector whose second half
  has an even sum enters the neighbours' cells too, an odd one only its own.

Equal fingerprints are one point of the grid, however many documents share
them.  Within a cell, links are followed breadth first through what is not yet
reached, so that a cell of near copies yields a spanning forest, not its pairs.
A cell that a hashed sample of the fingerprints shows to be very large is split
into blocks, and every two of its blocks meet in a task of their own; whether a
cell is split changes where its links are found, never which.

Defined results: null and empty texts have the fingerprint zero, which links
like any other; a null doc_id is never a component's id unless the component
has no other; repeated rows are returned as often as they come.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import byte_texts, map_arrow, materialize
from tidelog.llm.components import connected_components

WORDS = 4
BITS = 4
#: Rows of the sorted cell table that are worked on together.
BLOCK = 200_000
#: Cells up to this size are compared pair by pair.
SMALL_CELL = 32
#: Cells that seem to have more rows are split into blocks of about half as many.
LARGE_CELL = 50_000
#: One fingerprint in so many is looked at to find them.
SAMPLE = 64

_PAIRS = np.uint64(0x5555555555555555)
_LOW = np.uint64(0xFFFFFFFF)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, from the least."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255 * 256):
        part = hashes[at : at + 255 * 256]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)
        # eight bits to a word; 255 ones fit in a byte
        sums = np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0)
        total += sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: bytes | None) -> int:
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= WORDS:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined = memoryview(b" ".join(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[: 1 - WORDS].tolist(), ends[WORDS - 1 :].tolist(), strict=True)
    h = np.fromiter((digest(joined[a:b], 42) for a, b in pairs), np.uint64, len(words) - WORDS + 1)
    over = 2 * bit_counts(h) > len(h)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and ``fp``, the fingerprint as a signed long."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = np.array([fingerprint(t) for _, texts in byte_texts(batch) for t in texts], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, fp long")


def _neighbours(cell: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their cells) one step away, for cells of 16 counts of 0 to 2."""
    for i in range(16):
        count = (cell >> np.uint64(2 * i)) & np.uint64(3)
        one = np.uint64(1) << np.uint64(2 * i)
        up, down = np.flatnonzero(count < 2), np.flatnonzero(count > 0)
        yield up, cell[up] + one
        yield down, cell[down] - one


def grid_cells(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) for every cell that each fingerprint enters."""
    counts = fp - ((fp >> np.uint64(1)) & _PAIRS)
    first, second = counts >> np.uint64(32), counts & _LOW
    every = np.arange(len(fp))
    rows, cells = [every, every], [first, second | np.uint64(1 << 32)]
    for r, c in _neighbours(first):
        rows.append(r)
        cells.append(c)
    even = np.flatnonzero(np.bitwise_count(fp & _LOW) % 2 == 0)
    for r, c in _neighbours(second[even]):
        rows.append(even[r])
        cells.append(c | np.uint64(1 << 32))
    return np.concatenate(rows), np.concatenate(cells)


def _forest(fp: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that span each component of one cell."""
    found, left = [], fp
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= bits
            if near.any():
                new = left[near]
                found.append((np.full(len(new), x), new))
                queue.extend(new)
                left = left[~near]
    return found


def cell_links(cell: np.ndarray, fp: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links within the cells of a table sorted by cell."""
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    sizes = np.diff(np.append(starts, len(cell)))
    found = []
    small = np.repeat((sizes > 1) & (sizes <= SMALL_CELL), sizes)
    c, x = cell[small], fp[small]
    for d in range(1, min(SMALL_CELL, int(sizes.max()))):
        if d >= len(c):
            break
        i = np.flatnonzero(c[d:] == c[:-d])
        if not len(i):
            break
        i = i[np.bitwise_count(x[i] ^ x[i + d]) <= bits]
        found.append((x[i], x[i + d]))
    for k in np.flatnonzero(sizes > SMALL_CELL).tolist():
        found += _forest(fp[starts[k] : starts[k] + sizes[k]], bits)
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    return a, b


def _split_large(cells: DataFrame, sampled: DataFrame, large: int, sample: int) -> DataFrame:
    """Deals the rows of large cells out to pairs of blocks, as cells of their own.

    A cell's number has 33 bits; two block numbers of 14 bits go above it.
    """
    hot = sampled.groupBy("cell").agg((F.count("*") * sample).alias("n")).where(F.col("n") > large)
    blocks = F.least(F.ceil(F.col("n") * 2 / large), F.lit((1 << 14) - 1))
    hot = materialize(hot.select(F.col("cell").alias("hot"), blocks.alias("blocks")), "cells")
    if not hot.limit(1).count():
        return cells
    marked = cells.join(hot, cells["cell"] == hot["hot"], "left")
    own = F.pmod(F.xxhash64("fp"), "blocks")
    whole = marked.where("hot is null").select("cell", "fp")
    parts = marked.where("hot is not null").select("cell", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    number = F.col("cell") + F.shiftleft(F.least("own", "other"), 34) + F.shiftleft(F.greatest("own", "other"), 48)
    return whole.union(parts.select(number.alias("cell"), "fp"))


def links(distinct: DataFrame, bits: int = BITS, large: int = LARGE_CELL, sample: int = SAMPLE) -> DataFrame:
    """(a, b): links between different fingerprints of ``distinct``, enough of them to span every component."""
    if bits != BITS:
        raise ValueError(f"the grid is laid out for {BITS} bits")

    def spread(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fp = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        rows, cells = grid_cells(fp)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cells.view(np.int64)), pa.array(fp[rows].view(np.int64))], names=["cell", "fp"]
        )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0

        def joined(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows
            if not held:
                return
            cell, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = len(cell) if last else int(np.searchsorted(cell, cell[-1]))
            held, rows = [(cell[cut:], fp[cut:])] if cut < len(cell) else [], len(cell) - cut
            if cut:
                a, b = cell_links(cell[:cut], fp[:cut].view(np.uint64), bits)
                a, b = np.minimum(a, b), np.maximum(a, b)
                pair = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.empty((0, 2), np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ascontiguousarray(pair[:, i]).view(np.int64)) for i in (0, 1)], names=["a", "b"]
                )

        for batch in batches:
            if batch.num_rows:
                held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)))
                rows += batch.num_rows
                if rows >= BLOCK:
                    yield from joined(False)
        yield from joined(True)

    own = distinct.select("fp")
    some = own.where(F.pmod(F.xxhash64(F.lit(11), "fp"), F.lit(sample)) == 0)
    cells, sampled = (map_arrow(x, spread, "cell long, fp long") for x in (own, some))
    cells = _split_large(cells, sampled, large, sample)
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cells.repartition(n, "cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(join, "a long, b long").distinct()


def components(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, ``fp``, component_id and ``root``, the component's least fingerprint, of every document."""
    fps = materialize(fingerprints(docs), "fingerprints")
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = connected_components(links(classes, bits))
    named = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = materialize(named, "named")
    # written, so that the join below reads plain exchanges, which Spark can split where a component is large
    least = materialize(named.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    of = named.join(least, "root").select("fp", "component_id", "root")
    return fps.join(of, "fp").select("doc_id", "fp", "component_id", "root")


def near_duplicates(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every document."""
    return components(docs, bits).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """The document with the component's id of each component, with all its columns.

    Of rows that repeat that id within the component, one stays.
    """
    found = materialize(components(docs, bits), "components")
    rows, ids = found.agg(F.count("*"), F.countDistinct("doc_id")).first()
    if rows == ids:  # every row has its own doc_id, so a component's id is one row
        best = found.where("doc_id = component_id").select(F.col("doc_id").alias("_best"))
        return docs.join(best, docs["doc_id"].cast("long") == best["_best"], "left_semi")
    own = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    schema = T.StructType([own.schema["row"], T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType())])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fp = np.array([fingerprint(t) for _, texts in byte_texts(batch) for t in texts], np.uint64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("doc_id"), pa.array(fp.view(np.int64))], names=["row", "doc_id", "fp"]
        )

    of = found.select(F.col("fp").alias("_fp"), "component_id", "root").distinct()
    marked = map_arrow(own, run, schema)
    ranked = marked.join(of, marked["fp"] == of["_fp"]).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    order = W.partitionBy("root").orderBy("fp", F.col("row.text"))
    return ranked.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("row.*")
