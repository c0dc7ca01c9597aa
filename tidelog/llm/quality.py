"""Quality rules: gradient-boosted trees over document statistics.

Trees are grown on histograms of binned statistics with a logistic loss.
Monotonic constraints on chosen statistics hold by construction: a split on a
constrained statistic is only taken if its two values are in order, and their
midpoint then bounds everything below it.  A fitted forest is flattened into
numpy node arrays (statistic, threshold, value; children of node i at 2i+1 and
2i+2), and a batch of documents descends all trees at once.

Labels of the held-out quarter of doc_ids are never learned from, so that the
forest's verdicts can be measured there.

Defined results: null and empty texts have no words; texts of any length are
measured whole; documents without both label classes to learn from are judged by
the base rules alone; a null label, or one without a doc_id, teaches nothing, and
of several labels of a doc_id the least counts; a probability of exactly the
threshold stays; repeated rows, and rows without a doc_id, are judged one by one;
an empty table gives an empty one; other columns, whatever their names, are
ignored here and kept by :func:`filter_quality`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import bounded_sample, byte_texts, held_out, map_arrow, small_batches

#: Statistics a forest sees, each with its constraint: -1 means that more of it never raises quality.
STATISTICS = {
    "log_words": 0,
    "mean_word_chars": 0,
    "symbol_share": -1,
    "pipe_share": -1,
    "bang_share": -1,
    "upper_share": -1,
    "digit_share": 0,
    "dup_line_share": -1,
    "repeat_share": -1,
    "distinct_share": 1,
    "same_next_share": -1,
    "stop_share": 0,
    "words_per_line": 0,
    "other_script_share": 0,
}

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Least probability of quality to stay: below one half, so that unfamiliar but clean texts are not lost.
THRESHOLD = 0.3


def _class(chars: bytes) -> np.ndarray:
    mask = np.zeros(256, bool)
    mask[np.frombuffer(chars, np.uint8)] = True
    return mask


_CLASSES = np.stack(
    [
        _class(b" \t\n\x0b\x0c\r"),
        _class(b"#*$%&|<>"),
        _class(bytes(range(0x80, 0xC0))),
        _class(b"|"),
        _class(b"!"),
        _class(bytes(range(65, 91))),
        _class(bytes(range(48, 58))),
        _class(b".,;:?"),
        _class(bytes(range(0xC0, 0x100))),
    ]
).astype(np.float64)


def repeated_window_words(words: list[bytes], codes: np.ndarray, k: int = WINDOW) -> int:
    """How many words lie in a ``k``-word window that is found twice or more in the text.

    Windows are compared by a 64-bit hash first; those that agree are compared
    word by word.
    """
    n = len(words) - k + 1
    if n < 2:
        return 0
    hashes = np.zeros(n, np.uint64)
    for i in range(k):
        hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n]
    order = np.sort(hashes)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(hashes, twice))
    keys = [tuple(words[s : s + k]) for s in starts.tolist()]
    seen = Counter(keys)
    edge = np.zeros(len(words) + 1, np.int64)
    for s, key in zip(starts.tolist(), keys, strict=True):
        if seen[key] > 1:
            edge[s] += 1
            edge[s + k] -= 1
    return int((np.cumsum(edge) > 0).sum())


def measure(text: bytes | None) -> tuple[list[int], list[float]]:
    """The five base counts and the statistics of one document."""
    text = text or b""
    words = text.split()
    n = len(words)
    space, symbols, inner, pipes, bangs, upper, digits, stops, lead = (
        _CLASSES @ np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    ).tolist()
    chars = len(text) - inner - space
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup_lines = len(lines) - len(set(lines))
    codes = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    repeat = repeated_window_words(words, codes)
    each, per_word = max(chars, 1.0), max(n, 1)
    base = [n, int(chars), int(symbols), dup_lines, repeat]
    return base, [
        float(np.log1p(n)),
        chars / per_word,
        symbols / each,
        pipes / each,
        bangs / each,
        upper / each,
        digits / each,
        dup_lines / max(len(lines), 1),
        repeat / per_word,
        len(set(words)) / per_word,
        float((codes[1:] == codes[:-1]).sum()) / per_word,
        stops / each,
        n / max(len(lines), 1),
        lead / each,
    ]


@dataclass
class Forest:
    """Boosted trees as node arrays of shape (trees, 2 ** (depth + 1) - 1)."""

    statistic: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))[:, None]
        trees = np.arange(len(self.value))[None, :]
        at = np.zeros((len(x), len(self.value)), np.int64)
        for _ in range(self.depth):
            right = x[rows, self.statistic[trees, at]] > self.threshold[trees, at]
            at = 2 * at + 1 + right
        return self.base + self.value[trees, at].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.log_odds(x)))


def fit_forest(
    x: np.ndarray,
    y: np.ndarray,
    monotone: list[int],
    trees: int = 60,
    depth: int = 3,
    rate: float = 0.2,
    bins: int = 64,
    least: float = 4.0,
    l2: float = 1.0,
) -> Forest:
    """Grow ``trees`` trees of ``depth`` levels; ``least`` is the least Hessian weight of a leaf."""
    rows, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)], axis=1)
    nodes = 2 ** (depth + 1) - 1
    out = Forest(
        np.zeros((trees, nodes), np.int64), np.full((trees, nodes), np.inf), np.zeros((trees, nodes)), 0.0, depth
    )
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    out.base = float(np.log(share / (1 - share)))
    score = np.full(rows, out.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = p - y, p * (1 - p)
        at = np.zeros(rows, np.int64)
        low, high = np.full(nodes, -np.inf), np.full(nodes, np.inf)
        out.value[t, 0] = -grad.sum() / (hess.sum() + l2)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            local = at - first
            gain_of = np.zeros(count)
            chosen = np.full(count, -1)
            cut = np.zeros(count, np.int64)
            left_v, right_v = np.zeros(count), np.zeros(count)
            lo, hi = low[first : first + count, None], high[first : first + count, None]
            for f in range(width):
                m = len(edges[f]) + 1
                if m < 2:
                    continue
                key = local * m + binned[:, f]
                g = np.bincount(key, grad, count * m).reshape(count, m)
                h = np.bincount(key, hess, count * m).reshape(count, m)
                gl, hl = np.cumsum(g, 1)[:, :-1], np.cumsum(h, 1)[:, :-1]
                ga, ha = g.sum(1, keepdims=True), h.sum(1, keepdims=True)
                gr, hr = ga - gl, ha - hl
                vl, vr = np.clip(-gl / (hl + l2), lo, hi), np.clip(-gr / (hr + l2), lo, hi)
                va = np.clip(-ga / (ha + l2), lo, hi)
                worth = lambda g_, h_, v: -(g_ * v + 0.5 * (h_ + l2) * v * v)
                gain = worth(gl, hl, vl) + worth(gr, hr, vr) - worth(ga, ha, va)
                gain[(hl < least) | (hr < least)] = -np.inf
                if monotone[f]:
                    gain[(vr - vl) * monotone[f] < 0] = -np.inf
                best = gain.argmax(1)
                got = gain[np.arange(count), best]
                better = got > gain_of + 1e-9
                gain_of[better], chosen[better], cut[better] = got[better], f, best[better]
                left_v[better], right_v[better] = (
                    vl[np.arange(count), best][better],
                    vr[np.arange(count), best][better],
                )
            for j in range(count):
                node, a, b = first + j, 2 * (first + j) + 1, 2 * (first + j) + 2
                low[[a, b]], high[[a, b]] = low[node], high[node]
                if chosen[j] < 0:
                    out.value[t, a] = out.value[t, b] = out.value[t, node]
                    continue
                f = int(chosen[j])
                out.statistic[t, node], out.threshold[t, node] = f, edges[f][cut[j]]
                out.value[t, a], out.value[t, b] = left_v[j], right_v[j]
                middle = (left_v[j] + right_v[j]) / 2
                if monotone[f] > 0:
                    high[a], low[b] = middle, middle
                elif monotone[f] < 0:
                    low[a], high[b] = middle, middle
            right = x[np.arange(rows), out.statistic[t, at]] > out.threshold[t, at]
            at = 2 * at + 1 + right
        out.value[t] *= rate
        score += out.value[t, at]
    return out


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id with the base counts and the array ``stats`` of :data:`STATISTICS`."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        base, stats = [], []
        for _, texts in byte_texts(batch):
            for text in texts:
                b, s = measure(text)
                base.append(b)
                stats.append(s)
        columns = np.array(base, np.int64).T
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *map(pa.array, columns), pa.array(stats, pa.list_(pa.float64()))],
            names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "stats"],
        )

    return map_arrow(
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")),
        run,
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "stats array<double>",
    )


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 10_000, **growth) -> Forest | None:
    """A forest fitted on the statistics of at most about ``max_rows`` labelled documents that are not held out.

    Only statistics reach the driver.  None if the sample lacks a class.
    """
    marked = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg((F.min("quality") > 0).cast("int").alias("quality"))
    )
    marked = F.broadcast(bounded_sample(marked, ["doc_id"], max_rows, "quality"))  # bounded by max_rows and the number of labels
    ours = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        marked.select("doc_id"), "doc_id", "left_semi"
    )
    got = statistics(ours).select("doc_id", "stats").join(marked, "doc_id").select("stats", "quality").toPandas()
    if got.empty or got.quality.nunique() < 2:
        return None
    order = np.lexsort(np.stack(got.stats.to_list()).T)  # row order of a collect is not fixed
    x, y = np.stack(got.stats.to_list())[order], got.quality.to_numpy(np.float64)[order]
    return fit_forest(x, y, list(STATISTICS.values()), **growth)


def judge(docs: DataFrame, forest: Forest | None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: base counts, ``base_failed``, ``kept`` and ``quality`` (null without a forest)."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        base, stats = [], []
        for _, texts in byte_texts(batch):
            for text in texts:
                b, s = measure(text)
                base.append(b)
                stats.append(s)
        b, x = np.array(base, np.int64), np.array(stats)
        failed = (b[:, 0] < MIN_WORDS) | (100 * b[:, 4] > MAX_REPEAT_PERCENT * b[:, 0])
        if forest is None:
            quality, good = pa.nulls(len(b), pa.float64()), np.ones(len(b), bool)
        else:
            p = forest.probability(x)
            quality, good = pa.array(p), p >= threshold
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *map(pa.array, b.T), pa.array(failed), pa.array(~failed & good), quality],
            names=[
                "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                "base_failed", "kept", "quality",
            ],
        )

    return map_arrow(
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")),
        run,
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, quality double",
    )


def filter_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_rows: int = 10_000) -> DataFrame:
    """The documents that the rules keep, with all their columns.  Needs no join: rows are filtered as they pass."""
    forest = fit_quality(docs, labels, max_rows)
    small_batches(docs.sparkSession)
    names = docs.columns
    at = names.index("text")
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for first in range(0, batch.num_rows, 128):
                texts = batch.column(at).slice(first, 128).cast(pa.binary()).to_pylist()
                got = [measure(text) for text in texts]
                b, x = np.array([g[0] for g in got], np.int64), np.array([g[1] for g in got])
                ok = (b[:, 0] >= MIN_WORDS) & (100 * b[:, 4] <= MAX_REPEAT_PERCENT * b[:, 0])
                keep.append(ok if forest is None else ok & (forest.probability(x) >= threshold))
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return plain.mapInArrow(run, plain.schema).toDF(*names)
