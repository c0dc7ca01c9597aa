"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts of up to three bytes with symbol
counts, gathered from training texts and then frozen.  A byte is coded in the
longest context that the language has seen; if the byte is new there, an escape
is coded (method C: a context with N symbols, D of them different, escapes with
probability D / (N + D)) and the next shorter context is tried without the
symbols just excluded; below order 0 a byte unseen by the language costs its
share of what is left of 256.  The language with the shortest code wins, and
the score is its posterior share under equal priors.

A byte's cost depends on it and the three before it alone, so it is worked out
once for each four-byte gram that occurs, by look-ups in sorted counts, and
remembered; a text is scored by table lookups.  All 256 byte values count.

Defined results: null, empty and letterless texts are ``und`` with score 0; texts
of any length are scored whole; of equal code lengths the first language in order
of its name wins; without training rows everything is ``und``; a null doc_id is
never held out; repeated rows, and rows without a doc_id, are scored one by one; an
empty table gives an empty one; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import CHUNK_ROWS, bounded_sample, held_out, map_arrow

ORDER = 3
#: Costs that a worker remembers, over all languages; beyond it the memory starts anew.
MEMORY = 8_000_000

#: An odd number that spreads grams over slots.
_SPREAD = np.uint32(0x9E3779B1)

_letter = regex.compile(r"\p{L}").search
_PAD = np.full(ORDER, ord("\n"), np.uint8)


def byte_grams(text: bytes) -> np.ndarray:
    """Each byte with the three before it, as one number; the text follows line feeds."""
    x = np.concatenate([_PAD, np.frombuffer(text, np.uint8)]).astype(np.uint32)
    return x[:-3] << 24 | x[1:-2] << 16 | x[2:-1] << 8 | x[3:]


@dataclass
class Model:
    """Counts of four-byte grams of each language."""

    languages: list[str]
    language: np.ndarray
    gram: np.ndarray
    count: np.ndarray

    def digest(self) -> str:
        parts = [repr(self.languages).encode(), self.language.tobytes(), self.gram.tobytes(), self.count.tobytes()]
        return hashlib.sha256(b"".join(parts)).hexdigest()


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key in a sorted table that is not empty, and whether it is there."""
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class _Order:
    """One language's counts after contexts of one length, and what is left of the next shorter one."""

    def __init__(self, gram: np.ndarray, n: np.ndarray, width: int, shorter: _Order | None):
        self.width = width
        self.key, back = np.unique(gram & np.uint32((1 << 8 * (width + 1)) - 1), return_inverse=True)
        self.n = np.bincount(back, n)
        self.context, of = np.unique(self.key >> np.uint32(8), return_inverse=True)
        self.total, self.kinds = np.bincount(of, self.n), np.bincount(of)
        if shorter is not None:
            # whatever is seen here is seen in the shorter context
            known = shorter.n[shorter.place(self.key)[0]]
            at, _ = shorter.place_of_context(self.key[np.unique(of, return_index=True)[1]])
            self.left = shorter.total[at] - np.bincount(of, known)
            self.left_kinds = shorter.kinds[at] - self.kinds

    def place(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _find(self.key, gram & np.uint32((1 << 8 * (self.width + 1)) - 1))

    def place_of_context(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _find(self.context, gram >> np.uint32(8) & np.uint32((1 << 8 * self.width) - 1))


class Coder:
    """Code lengths in bits of every (context, byte) under each language."""

    def __init__(self, model: Model):
        self.languages, self.orders = model.languages, []
        for k in range(len(self.languages)):
            own, orders = model.language == k, []
            for width in range(ORDER + 1):
                orders.append(_Order(model.gram[own], model.count[own], width, orders[-1] if orders else None))
            self.orders.append(orders)
        self._forget()

    def _forget(self) -> None:
        self.gram, self.cost = np.empty(0, np.uint32), np.empty((0, len(self.languages)), np.float32)
        self._slot, self._shift = np.zeros(1, np.int32), np.uint32(31)

    def _lay_out(self) -> None:
        """One place of each hash value, for look-ups without a search; a gram that lost its slot is searched for."""
        bits = max(4, (4 * len(self.gram)).bit_length())
        self._slot, self._shift = np.zeros(1 << bits, np.int32), np.uint32(32 - bits)
        self._slot[self.gram * _SPREAD >> self._shift] = np.arange(len(self.gram), dtype=np.int32)

    def _places(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each gram in the memory, which is not empty, and whether it is there."""
        at = self._slot[gram * _SPREAD >> self._shift]
        known = self.gram[at] == gram
        other = np.flatnonzero(~known)
        if len(other):
            at[other], known[other] = _find(self.gram, gram[other])
        return at, known

    def costs(self, gram: np.ndarray) -> np.ndarray:
        """The cost of the last byte of each gram (rows) under each language."""
        out = np.zeros((len(gram), len(self.languages)))
        for k, orders in enumerate(self.orders):
            todo, longer = np.arange(len(gram)), np.full(len(gram), -1)
            for order in reversed(orders):
                g = gram[todo]
                context, met = order.place_of_context(g)
                at, seen = order.place(g)
                total, kinds = order.total[context], order.kinds[context]
                if order.width < ORDER:
                    # without the symbols of the longer context that was escaped from
                    above, cut = orders[order.width + 1], longer[todo] >= 0
                    total = np.where(cut, above.left[longer[todo]], total)
                    kinds = np.where(cut, above.left_kinds[longer[todo]], kinds)
                part = np.where(seen, order.n[at], kinds)
                coded = met & (part > 0)
                out[todo[coded], k] += np.log2((total[coded] + kinds[coded]) / part[coded])
                longer[todo] = np.where(met, context, -1)
                todo = todo[~seen]
            out[todo, k] += np.log2(max(256 - int(orders[0].kinds[0]), 1))
        return out

    def _rows(self, gram: np.ndarray) -> np.ndarray:
        """Places in the memory of the costs of these grams, which are worked out if they are new."""
        if len(self.gram):
            at, known = self._places(gram)
            if known.all():
                return at
            new = np.unique(gram[~known])
        else:
            new = np.unique(gram)
        if (len(self.gram) + len(new)) * len(self.languages) > MEMORY:
            self._forget()
            new = np.unique(gram)
        to = np.searchsorted(self.gram, new)
        self.cost = np.insert(self.cost, to, self.costs(new), axis=0)
        self.gram = np.insert(self.gram, to, new)
        self._lay_out()
        return self._places(gram)[0]

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text (rows, none empty) under each language."""
        sizes = np.array([len(t) for t in texts])
        out = np.empty((len(texts), len(self.languages)))
        at = self._rows(byte_grams((b"\n" * ORDER).join(texts)))
        rows = self.cost[at]
        begin = np.cumsum(sizes + ORDER) - (sizes + ORDER)
        for i, (a, n) in enumerate(zip(begin.tolist(), sizes.tolist(), strict=True)):
            out[i] = rows[a : a + n].sum(axis=0, dtype=np.float64)
        return out


_coders: dict[str, Coder] = {}


def coder(model: Model, digest: str) -> Coder:
    """The tables of a model, built once a Python worker."""
    if digest not in _coders:
        _coders.clear()
        _coders[digest] = Coder(model)
    return _coders[digest]


def fit_language(docs: DataFrame, max_docs: int = 6_000) -> Model:
    """Gram counts of at most about ``max_docs`` labelled documents that are not held out, whole texts."""
    marked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).where(
        F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))
    )

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        langs = batch.column("lang").to_pylist()
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        for lang in sorted(set(langs)):
            own = [byte_grams(t) for t, x in zip(texts, langs, strict=True) if x == lang and t]
            if own:
                gram, n = np.unique(np.concatenate(own), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(gram)), pa.array(gram.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"]
                )

    sample = bounded_sample(marked, ["doc_id", "text"], max_docs, "lang")
    counts = map_arrow(sample, run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    got = counts.toPandas().sort_values(["lang", "gram"])  # bounded by the sample
    languages = sorted(set(got.lang))
    return Model(
        languages,
        got.lang.map({x: i for i, x in enumerate(languages)}).to_numpy(np.int16),
        got.gram.to_numpy(np.uint32),
        got.n.to_numpy(np.int64),
    )


def identify(docs: DataFrame, model: Model, undetermined: str = "und") -> DataFrame:
    """doc_id, held_out, lang_pred, score, and bits_per_byte, the winner's code length."""
    digest = model.digest()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        langs, scores, rates = [], [], []
        made = coder(model, digest) if model.languages else None
        for at in range(0, batch.num_rows, CHUNK_ROWS):
            texts = batch.column("text").slice(at, CHUNK_ROWS).to_pylist()
            known = [i for i, t in enumerate(texts) if made and t and _letter(t)]
            lang, score, rate = [undetermined] * len(texts), [0.0] * len(texts), [None] * len(texts)
            if known:
                data = [texts[i].encode("utf-8", "replace") for i in known]
                bits = made.bits(data)
                best = bits.argmin(axis=1)
                share = 1 / np.exp2(np.clip(bits.min(axis=1, keepdims=True) - bits, -1000, 0)).sum(axis=1)
                for j, i in enumerate(known):
                    lang[i], score[i] = model.languages[best[j]], float(share[j])
                    rate[i] = float(bits[j, best[j]] / len(data[j]))
            langs += lang
            scores += score
            rates += rate
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array(langs), pa.array(scores), pa.array(rates, pa.float64())],
            names=["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"],
        )

    return map_arrow(
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held_out(F.col("doc_id")).alias("held_out")),
        run,
        "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double",
    )
