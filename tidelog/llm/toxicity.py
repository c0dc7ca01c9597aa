"""Toxicity: multiple-instance learning over sentences.

A sentence is a maximal run without ``. ! ?`` or a line feed; its logit is a
bias plus the weights of its words and of their first four letters.  A document
is toxic unless every sentence is clean (noisy-or), so

    P(toxic) = 1 - prod(1 - p_s) = 1 - exp(-sum(softplus(logit_s)))

and the weights are learned from document labels alone by proximal gradient
steps under an L1 penalty, which takes weights that do not help to zero.  The
same sentence scores then locate the offending sentences.

Defined results: a null or empty text has no sentence and scores 0; texts of any
length are scored whole; of equally bad sentences the first is the worst; a
training sample without both classes gives a model that scores every document 0;
a null label, or one without a doc_id, teaches nothing, and of several labels of
a doc_id the greatest counts; repeated rows, and rows without a doc_id, are scored
one by one; an empty table gives an empty one; columns other than doc_id and text
are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import CHUNK_ROWS, bounded_sample, held_out, map_arrow

THRESHOLD = 0.3
#: Lengths of the beginnings of longer words that are features beside the word.
PREFIXES = (4,)
#: Words whose weight a task remembers; beyond it the memory starts anew.
MEMORY = 200_000

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[int]:
    """Hashes of a lower-cased word and of its beginnings."""
    found = [crc32(word.encode("utf-8", "replace"))]
    found += [crc32(b"^" + word[:n].encode("utf-8", "replace")) for n in PREFIXES if len(word) > n]
    return found


def sentences(text: str | None) -> list[tuple[int, int, list[str]]]:
    """(start, end, lower-cased words) of each sentence that has a word."""
    found = []
    for m in _SENTENCE.finditer(text or ""):
        words = _WORD.findall(m.group().lower())
        if words:
            found.append((m.start(), m.end(), words))
    return found


@dataclass
class Model:
    weights: dict[int, float]
    bias: float


class _Memory(dict):
    """Weight of a word, worked out when first met."""

    def __init__(self, weights: dict[int, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= MEMORY:
            self.clear()
        value = sum(self.weights.get(f, 0.0) for f in features(word))
        self[word] = value
        return value


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def sentence_slopes(z: np.ndarray, y: np.ndarray, doc_at: np.ndarray, doc_of: np.ndarray) -> np.ndarray:
    """How the mean negative log-likelihood of the labels ``y`` changes with each sentence's logit ``z``.

    Document i has the sentences from ``doc_at[i]`` on; sentence j is in document ``doc_of[j]``.
    """
    total = np.add.reduceat(_softplus(z), doc_at)
    slope = np.where(y > 0, -1 / np.expm1(np.clip(total, 1e-9, 500)), 1.0)
    return slope[doc_of] / (1 + np.exp(-np.clip(z, -500, 500))) / len(y)


def fit(
    bags: list[tuple[int, list[np.ndarray]]],
    steps: int = 240,
    rate: float = 0.3,
    l1: float = 3e-5,
    bias: float = -8.0,
    least_docs: int = 3,
) -> Model:
    """Weights from (label, [feature hashes of each sentence]) of each document.

    Weights start at the lower end of the confidence interval of their features'
    log odds between toxic and clean documents, at 0 if that is below 0.
    """
    bags = [b for b in bags if b[1]]
    if len({y for y, _ in bags}) < 2:
        return Model({}, -np.inf)
    y = np.array([y for y, _ in bags], np.float64)
    counts = np.array([len(s) for _, s in bags])
    doc_at = np.concatenate([[0], np.cumsum(counts)])[:-1]
    lengths = np.array([len(s) for _, each in bags for s in each], np.int32)
    kinds, code = np.unique(np.concatenate([s for _, each in bags for s in each]), return_inverse=True)
    code = code.astype(np.int32)
    in_docs, in_toxic = np.zeros(len(kinds)), np.zeros(len(kinds))
    ends = np.cumsum(np.add.reduceat(lengths, doc_at))
    for label, first, last in zip(y.tolist(), (ends - np.diff(ends, prepend=0)).tolist(), ends.tolist(), strict=True):
        own = np.unique(code[first:last])
        in_docs[own] += 1
        in_toxic[own] += label
    keep = in_docs >= least_docs
    used = keep[code]
    code = (np.cumsum(keep, dtype=np.int32) - 1)[code[used]]
    n_sentences = len(lengths)
    sentence = np.repeat(np.arange(n_sentences, dtype=np.int32), lengths)[used]
    del used
    kinds, bad = kinds[keep], in_toxic[keep] + 0.5
    good = in_docs[keep] - in_toxic[keep] + 0.5
    odds = np.log(bad / y.sum()) - np.log(good / (len(y) - y.sum()))
    w, seen = np.maximum(odds - 2 * np.sqrt(1 / bad + 1 / good), 0), np.full(len(kinds), 1e-12)
    b, seen_b = bias, 1e-12
    doc_of = np.repeat(np.arange(len(bags)), counts)
    # sums over the entries of each sentence that has any, and over those of each feature
    first_of = np.flatnonzero(np.diff(sentence, prepend=-1))
    some, by_kind = sentence[first_of], sentence[np.argsort(code, kind="stable")]
    kind_at = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(kinds)))[:-1]])
    for _ in range(steps if len(code) else 0):
        z = np.full(n_sentences, b)
        z[some] += np.add.reduceat(w[code], first_of)
        r = sentence_slopes(z, y, doc_at, doc_of)
        g, gb = np.add.reduceat(r[by_kind], kind_at), r.sum()
        seen, seen_b = seen + g * g, seen_b + gb * gb
        step = rate / np.sqrt(seen)
        w = w - step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        b -= 0.2 * rate / np.sqrt(seen_b) * gb
    alive = np.flatnonzero(w)
    return Model(dict(zip(kinds[alive].tolist(), w[alive].tolist(), strict=True)), float(b))


def cross_validated(bags: list[tuple[int, list[np.ndarray]]], folds: int = 3, **how) -> dict[str, float]:
    """How models with the settings ``how`` do on the folds of the training bags that they were not fitted on."""
    loss = false_alarms = misses = 0
    for k in range(folds):
        model = fit([b for i, b in enumerate(bags) if i % folds != k], **how)
        for y, each in bags[k::folds]:
            z = model.bias + np.array([sum(model.weights.get(f, 0.0) for f in s.tolist()) for s in each])
            p = float(-np.expm1(-_softplus(z).sum())) if each else 0.0
            loss -= np.log(np.clip(p if y else 1 - p, 1e-6, 1)) / len(bags)
            false_alarms += p >= THRESHOLD and not y
            misses += p < THRESHOLD and y
    return {"log_loss": float(loss), "false_alarms": int(false_alarms), "misses": int(misses)}


def labelled_bags(docs: DataFrame, labels: DataFrame, max_docs: int = 5_000) -> list[tuple[int, list[np.ndarray]]]:
    """(label, [feature hashes of each sentence]) of at most about ``max_docs`` labelled documents that are not held out."""
    marked = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    )
    marked = F.broadcast(bounded_sample(marked, ["doc_id"], max_docs, "toxic"))  # bounded by max_docs and the number of labels
    ours = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).join(
        marked, "doc_id"
    )

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, ends = [], []
        for text in batch.column("text").to_pylist():
            each = [[f for word in words for f in features(word)] for _, _, words in sentences(text)]
            ids.append(np.array([f for s in each for f in s], "<u4").tobytes())
            ends.append(np.cumsum([len(s) for s in each], dtype="<i4").tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("toxic"), pa.array(ids, pa.binary()), pa.array(ends, pa.binary())],
            names=["doc_id", "toxic", "ids", "ends"],
        )

    bags = []
    got = map_arrow(ours, run, "doc_id long, toxic int, ids binary, ends binary").toPandas()
    for row in got.sort_values(["doc_id", "ids"]).itertuples():  # the order of a collect is not fixed
        ends = np.frombuffer(row.ends, "<i4")
        bags.append((row.toxic, np.split(np.frombuffer(row.ids, "<u4"), ends[:-1]) if len(ends) else []))
    return bags


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_docs: int = 5_000, **how) -> Model:
    """A model from at most about ``max_docs`` labelled documents that are not held out, whole texts."""
    return fit(labelled_bags(docs, labels, max_docs), **how)


def _scored(text: str | None, memory: _Memory, bias: float) -> tuple[float, list[tuple[int, int, float]]]:
    """P(toxic) of a document, and (start, end, probability) of each sentence."""
    found = sentences(text)
    if not found:
        return 0.0, []
    z = bias + np.array([sum(map(memory.__getitem__, words)) for _, _, words in found])
    each = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
    return float(-np.expm1(-_softplus(z).sum())), [(a, b, p) for (a, b, _), p in zip(found, each.tolist(), strict=True)]


def score(docs: DataFrame, model: Model, offending: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, and where the worst sentence is (null if there is none)."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        memory, rows = _Memory(model.weights), []
        for at in range(0, batch.num_rows, CHUNK_ROWS):
            for text in batch.column("text").slice(at, CHUNK_ROWS).to_pylist():
                p, each = _scored(text, memory, model.bias)
                start, end, worst = max(each, key=lambda x: x[2], default=(None, None, None))
                rows.append((p, len(each), sum(x[2] >= offending for x in each), start, end, worst))
        p, n, bad, start, end, worst = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), batch.column("held_out"), pa.array(p, pa.float64()),
                pa.array([int(x >= THRESHOLD) for x in p], pa.int32()), pa.array(n, pa.int64()), pa.array(bad, pa.int64()),
                pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(worst, pa.float64()),
            ],
            names=[
                "doc_id", "held_out", "score", "predicted", "n_sentences", "n_offending",
                "worst_start", "worst_end", "worst_score",
            ],
        )

    return map_arrow(
        docs.select(
            F.col("doc_id").cast("long"), F.col("text").cast("string"), held_out(F.col("doc_id")).alias("held_out")
        ),
        run,
        "doc_id long, held_out boolean, score double, predicted int, n_sentences long, n_offending long, "
        "worst_start long, worst_end long, worst_score double",
    )


def locate(docs: DataFrame, model: Model, offending: float = THRESHOLD) -> DataFrame:
    """One row per offending sentence: doc_id, start and end (code points), sentence, score."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        memory = _Memory(model.weights)
        for at in range(0, batch.num_rows, CHUNK_ROWS):
            part, rows = batch.slice(at, CHUNK_ROWS), []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                _, each = _scored(text, memory, model.bias)
                rows += [(doc_id, a, b, text[a:b], p) for a, b, p in each if p >= offending]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names
                )

    names = ["doc_id", "start", "end", "sentence", "score"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64()]
    return map_arrow(
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")),
        run,
        "doc_id long, start long, end long, sentence string, score double",
    )
