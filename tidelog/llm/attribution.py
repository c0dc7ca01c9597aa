"""Token counts by offset-mapped attribution.

A document is encoded whole, once.  Its tokens' character spans are then joined
to the character spans of its sections, and each token is counted where it
lies.  A token that crosses a boundary is allocated by an explicit rule:

* ``majority``: to the section with most of its characters, the earliest of equals;
* ``first``: to the section of its first character;
* ``last``: to the section of its last character.

Byte-level tokens may hold a part of a character; such a token's span is that
whole character.  Both lists of spans are in order, so the join is a search in
the sorted boundaries, not a product.  Counts over the sections of a document
add up to its token count under each rule.

White space of many thousand characters overflows the stack of the pattern's
engine, so such a run is cut out first, where the pattern itself cuts: all of it
at the end of a text, else all but its last character.  The ids stay the same.

Defined results: a null or empty text is one empty section without tokens;
repeated rows, rows of one doc_id and rows without one are counted one by one;
texts of any length are encoded whole; a token that two sections hold equal
parts of goes by the rule; a null field counts as empty; an empty table gives an
empty one; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import CHUNK_ROWS, map_arrow

RULES = ("majority", "first", "last")
#: How a pattern ends that takes a run of white space but for the last character before something else.
SPACE_RULE = r"|\s+(?!\S)|\s+"
#: Runs of white space of so many characters are cut out of a text before it is encoded.
LONG_SPACE = 10_000

_long_space = regex.compile(rf"\p{{White_Space}}{{{LONG_SPACE},}}").finditer


class Encoder:
    """Ids of a text, whatever is in it."""

    def __init__(self, encoding, pattern: str):
        self._encoding, self._cuts = encoding, pattern.endswith(SPACE_RULE)

    def __call__(self, text: str) -> list[int]:
        if len(text) < LONG_SPACE or not self._cuts:
            return self._encoding.encode_ordinary(text)
        ids, at = [], 0
        for run in _long_space(text):
            start, end = run.span()
            end -= end < len(text)
            ids += self._encoding.encode_ordinary(text[at:start])
            ids += self._encoding._encode_single_piece(text[start:end])  # one match of the pattern
            at = end
        return ids + self._encoding.encode_ordinary(text[at:])


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> tuple[Encoder, np.ndarray]:
    """The byte-level encoding of a rank file, and the bytes in each of its tokens."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        size[rank] = len(token)
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return Encoder(encoding, pattern), size


def token_spans(text: str, encode: Callable[[str], list[int]], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end, in code points, of each token of the text."""
    ids = np.array(encode(text), np.int64)
    ends = np.cumsum(size[ids])
    starts = ends - size[ids]
    if text.isascii():
        return starts, ends
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    char = np.cumsum((data & 0xC0) != 0x80) - 1
    return char[starts], char[ends - 1] + 1


def allocate(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of those cross a boundary.

    Sections are gapless: section i is ``[bounds[i], bounds[i + 1])``.
    """
    n = len(bounds) - 1
    first = np.searchsorted(bounds, starts, side="right") - 1
    last = np.searchsorted(bounds, ends - 1, side="right") - 1
    crossing = first != last
    to = last.copy() if rule == "last" else first.copy()
    if rule == "majority":
        for k in np.flatnonzero(crossing).tolist():
            s = np.arange(first[k], last[k] + 1)
            held = np.minimum(bounds[s + 1], ends[k]) - np.maximum(bounds[s], starts[k])
            to[k] = s[held.argmax()]
    return np.bincount(to, minlength=n), np.bincount(to[crossing], minlength=n)


def line_bounds(text: str) -> list[int]:
    """Sections are lines, each with its line feed."""
    found, at = [0], text.find("\n")
    while at >= 0:
        found.append(at + 1)
        at = text.find("\n", at + 1)
    if found[-1] < len(text) or len(found) == 1:
        found.append(len(text))
    return found


def _counted(df: DataFrame, spans: Callable, path: str, pattern: str, rule: str) -> DataFrame:
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        encode, size = tokenizer(path, pattern)
        for at in range(0, batch.num_rows, CHUNK_ROWS):
            part = batch.slice(at, CHUNK_ROWS)
            columns = [part.column(i).to_pylist() for i in range(1, part.num_columns)]
            ids, lengths, section, start, end, tokens, crossing = part.column(0), [], [], [], [], [], []
            for row in zip(*columns, strict=True):
                text, bounds = spans(row)
                bounds = np.array(bounds)
                starts, ends = token_spans(text, encode, size)
                counts, across = allocate(starts, ends, bounds, rule)
                lengths.append(len(counts))
                section.append(np.arange(len(counts)))
                start.append(bounds[:-1])
                end.append(bounds[1:])
                tokens.append(counts)
                crossing.append(across)
            owner = ids.take(pa.array(np.repeat(np.arange(len(lengths)), lengths)))
            flat = [pa.array(np.concatenate(x).astype(np.int64)) for x in (section, start, end, tokens, crossing)]
            yield pa.RecordBatch.from_arrays(
                [owner, *flat], names=["doc_id", "section", "start", "end", "n_tokens", "n_crossing"]
            )

    return map_arrow(
        df, run, "doc_id long, section long, start long, end long, n_tokens long, n_crossing long"
    )


def count_by_line(docs: DataFrame, path: str, pattern: str, rule: str = "majority") -> DataFrame:
    """One row per line of each document: section (from 0), start and end, n_tokens, n_crossing of them."""
    df = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return _counted(df, lambda row: (row[0] or "", line_bounds(row[0] or "")), path, pattern, rule)


def count_by_field(
    docs: DataFrame, fields: list[str], path: str, pattern: str, rule: str = "majority", separator: str = "\n"
) -> DataFrame:
    """One row per field of each document, encoded as its fields joined by ``separator``.

    A separator belongs to the field before it.
    """
    df = docs.select(F.col("doc_id").cast("long"), *[F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)])

    def spans(row: tuple) -> tuple[str, list[int]]:
        parts = [x or "" for x in row]
        parts = [p + separator for p in parts[:-1]] + parts[-1:]
        return "".join(parts), [0, *np.cumsum([len(p) for p in parts]).tolist()]

    return _counted(df, spans, path, pattern, rule)
