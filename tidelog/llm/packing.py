"""Packing by minimum bin slack.

Documents become pieces of at most ``capacity`` tokens.  Only how many pieces
have each length matters for filling sequences, and that table is bounded by
the capacity, so the driver plans on it: the longest piece left opens a
sequence, a bitset subset-sum over the lengths left finds the fullest
combination that fits beside it, and the combination is repeated while its
lengths last and then removed.  Each repetition uses up a length or nearly so;
the plan's size depends on the capacity, not on the corpus.

Every piece then finds its place from its length and its rank among pieces of
that length, by one search in the plan.  The task that cuts pieces counts them
by length as it writes them; a piece's rank is its number there plus the pieces
of tasks before, so nothing is ranked afterwards, and a very frequent length is
in no task more than any other.

Token ids are exactly those of the tokenizer over the whole text.  Its
pre-tokens never cross white space, so ids are remembered by pre-token; a text
with any character outside the range where the pre-tokens' pattern is known is
encoded by the tokenizer itself.

Defined results: a null text is empty; an empty text is the end token alone;
texts of any length are encoded whole and cut into pieces; repeated rows, rows of
one doc_id and rows without one are packed one by one; pieces of equal length are
interchangeable, so files and rows decide which goes where; an empty table gives
an empty one; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.llm.common import CHUNK_ROWS, map_arrow, materialize, small_batches

CAPACITY = 4096
END = 1
MEMORY = 400_000
#: A table of so many rows, three numbers each, travels to the tasks; a larger one is joined by shuffle.
MAX_BROADCAST_ROWS = 500_000

# White space, letters and digits up to U+017F as the tokenizer's pattern classes them.
_SAFE = "\t\n\r\x20-\x7e\xa1-įı-ſ"
_LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-ſ"
_DIGITS = "0-9\xb2\xb3\xb9\xbc\xbd\xbe"
_unsafe = re.compile(f"[^{_SAFE}]").search
_pre_tokens = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^\t\n\r {_LETTERS}{_DIGITS}]+"
).findall


def _byte_letters() -> list[str]:
    """Byte-level alphabets write printable bytes as themselves and the others, in order, from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class _Ids(dict):
    """Little-endian ids of a pre-token, worked out when first met."""

    def __init__(self, model):
        super().__init__()
        self.model, self.letters = model, _byte_letters()

    def __missing__(self, token: str) -> bytes:
        if len(self) >= MEMORY:
            self.clear()
        text = token if token.isascii() else "".join(map(self.letters.__getitem__, token.encode()))
        value = array("I", [t.id for t in self.model.tokenize(text)]).tobytes()
        if len(token) <= 64:
            self[token] = value
        return value


class Encoder:
    """Ids of a text by a word-level BPE file of ``tokenizers`` that lower-cases and drops white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = _Ids(self.tokenizer.model)

    def __call__(self, text: str) -> bytes:
        if _unsafe(text) or any(s in text for s in self.special):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.known.__getitem__, _pre_tokens(text.lower())))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One a Python worker: what it remembers serves later tasks."""
    return Encoder(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if kept, ids (little-endian, 32 bits each).

    ``task`` and ``nth`` number the pieces of each length in the task that cuts them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, width, seen = array("I", [END]).tobytes(), 4 * capacity, Counter()
        task = TaskContext.get().partitionId()
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                encode, part, rows, owner = encoder(path), batch.slice(at, CHUNK_ROWS), [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    ids = encode(text or "") + end
                    for k, first in enumerate(range(0, len(ids), width)):
                        own = ids[first : first + width]
                        length = len(own) // 4
                        owner.append(i)
                        rows.append((k, first // 4, length, crc32(own), own, seen[length]))
                        seen[length] += 1
                piece, start, length, crc, ids, nth = zip(*rows, strict=True)
                columns = [pa.array(x, pa.int64()) for x in (start, length, crc)]
                found = [part.column("doc_id").take(pa.array(owner)), pa.array(piece, pa.int32()), *columns]
                found += [pa.array(ids, pa.binary())] * keep_ids
                found += [pa.array([task] * len(rows), pa.int32()), pa.array(nth, pa.int64())]
                yield pa.RecordBatch.from_arrays(found, names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids, "task", "nth"]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids + ", task int, nth long"
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, how many) of the fullest combination of at most ``room``, long pieces first.

    Bit ``s`` of the set says that the lengths so far can sum to ``s``; the sets
    before each length are kept, to walk back from the best sum.
    """
    mask, bits, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x, n in counts.items() if n and x <= room), reverse=True):
        left, size = min(counts[length], room // length), 1
        while left:  # 1, 2, 4, ... copies at a time
            size = min(size, left)
            steps.append((length, size, bits))
            bits |= (bits << (length * size)) & mask
            left -= size
            size *= 2
            if bits >> room & 1:
                break
        if bits >> room & 1:
            break
    at, used = bits.bit_length() - 1, {}
    for length, size, before in reversed(steps):
        if not before >> at & 1:
            at -= length * size
            used[length] = used.get(length, 0) + size
    return sorted(used.items(), reverse=True)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(how many sequences, [(length, pieces of it in each)]) in the order they are filled."""
    left, found = {k: n for k, n in histogram.items() if n}, []
    while left:
        longest = max(left)
        if longest > capacity:
            raise ValueError("a piece is longer than a sequence")
        left[longest] -= 1
        inside = dict(fullest(left, capacity - longest))
        left[longest] += 1
        inside[longest] = inside.get(longest, 0) + 1
        times = min(left[k] // n for k, n in inside.items())
        found.append((times, sorted(inside.items(), reverse=True)))
        for k, n in inside.items():
            left[k] -= times * n
            if not left[k]:
                del left[k]
    return found


class Places:
    """The plan, laid out for search by (length, rank)."""

    def __init__(self, filled: list[tuple[int, list[tuple[int, int]]]]):
        rows, used, sequence = [], {}, 0
        for times, inside in filled:
            offset = 0
            for length, n in inside:
                rank = used.get(length, 0)
                rows.append((length << 44 | rank, rank, n, sequence, offset))
                used[length] = rank + times * n
                offset += length * n
            sequence += times
        rows.sort()
        self.key, self.rank, self.each, self.first, self.offset = np.array(rows, np.int64).reshape(-1, 5).T
        self.sequences = sequence

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(self.key, length << 44 | rank, side="right") - 1
        r = rank - self.rank[k]
        return self.first[k] + r // self.each[k], self.offset[k] + r % self.each[k] * length


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """The pieces, each with its sequence_id and its offset there."""
    cut = materialize(pieces(docs, path, capacity, keep_ids), "pieces")
    counts = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = materialize(
        counts.select(
            "length", "task", "n", (F.sum("n").over(W.partitionBy("length").orderBy("task")) - F.col("n")).alias("before")
        ),
        "ranks",
    )
    # at most `capacity` rows
    histogram = {r[0]: r[1] for r in before.groupBy("length").agg(F.sum("n")).collect()}
    places, names = Places(plan(histogram, capacity)), [c for c in cut.columns if c not in ("task", "nth")]
    # few tasks: the pieces are spared a shuffle
    small = before.count() <= MAX_BROADCAST_ROWS
    ranked = cut.join(before.hint("broadcast" if small else "merge"), ["length", "task"]).select(*names, (F.col("nth") + F.col("before")).alias("rank"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
        sequence, offset = places(length, rank)
        kept = [batch.column(c) for c in names]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema if f.name in names)
    return map_arrow(ranked, run, f"{schema}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence, from pieces packed with their ids.

    sequence_id, n_tokens, ids (little-endian, 32 bits each), doc_ids, and pieces (doc_id, piece, start, offset,
    length) in their order.  A group holds at most the capacity, as each of its pieces has a token at least.
    """
    columns = ["offset", "doc_id", "piece", "start", "length", "ids"]
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("parts"))
    joined = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), ""))
    return parts.select(
        "sequence_id",
        F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["length"]).alias("n_tokens"),
        joined.alias("ids"),
        F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"),
        F.transform("parts", lambda p: F.struct(*[p[c].alias(c) for c in ("doc_id", "piece", "start", "offset", "length")])).alias("pieces"),
    )
