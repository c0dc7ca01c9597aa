"""Token counts, shards, packing and the pipeline."""

import base64
import math
import random
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
import xxhash
from pyspark.sql import Row
from tokenizers import Tokenizer

import corpus_pipeline
from tidelog.llm import attribution, packing, quality, queries, sharding

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def encoding():
    """The tokenizer itself, without anything of the operator."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def slow_counts(encoding, text, bounds, rule):
    """Each token's characters, one by one."""
    tokens, at, char = Counter(), 0, []
    for i, c in enumerate(text):
        char += [i] * len(c.encode())
    section = [next(k for k in range(len(bounds) - 1) if bounds[k] <= i < bounds[k + 1]) for i in range(len(text))]
    for t in encoding.encode_ordinary(text):
        n = len(encoding.decode_single_token_bytes(t))
        own = sorted(set(char[at : at + n]))
        at += n
        held = Counter(section[i] for i in own)
        to = {"first": section[own[0]], "last": section[own[-1]], "majority": min(held, key=lambda k: (-held[k], k))}[rule]
        tokens[to] += 1
    return [tokens[k] for k in range(len(bounds) - 1)]


def slow_bounds(text):
    lines = text.split("\n")
    ends = np.cumsum([len(x) + 1 for x in lines]).tolist()
    ends = ends[:-1] if text.endswith("\n") else [*ends[:-1], len(text)]
    return [0, *(ends or [0])]


@pytest.mark.parametrize("rule", attribution.RULES)
def test_attribution_equals_brute_force(spark, odd_docs, no_docs, encoding, rule):
    """Long texts, null ids, repeated ids and repeated rows too."""
    more = ["a\n\n\nb", "\n", "x \n y\n\n", "é\n\U0001f600\n\n日本"]
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(list(enumerate(more, 90)), "doc_id long, text string"))
    got = attribution.count_by_line(docs, RANKS, PATTERN, rule).collect()
    want = []
    for r in docs.collect():
        text = r.text or ""
        bounds = slow_bounds(text)
        counts = slow_counts(encoding, text, bounds, rule) if text else [0]
        want += [(r.doc_id, k, a, b, n) for k, (a, b, n) in enumerate(zip(bounds[:-1], bounds[1:], counts, strict=True))]
    assert Counter(tuple(r)[:5] for r in got) == Counter(want)
    assert attribution.count_by_line(no_docs, RANKS, PATTERN).count() == 0
    with pytest.raises(ValueError):
        attribution.count_by_line(docs, RANKS, PATTERN, "all")


def test_long_white_space_keeps_its_ids(monkeypatch, encoding):
    """Runs are cut out where the pattern cuts: ids are those of the tokenizer over the whole text."""
    r, encode = random.Random(6), attribution.tokenizer(RANKS, PATTERN)[0]
    monkeypatch.setattr(attribution, "LONG_SPACE", 3)
    monkeypatch.setattr(attribution, "_long_space", attribution.regex.compile(r"\p{White_Space}{3,}").finditer)
    for _ in range(500):
        text = "".join(r.choices(["a", "é", "1", "'s", "!", " ", "  ", "\n", "\t", "\r\n", "\u3000", "\x85", "\x1c", "\u200b"], k=r.randint(0, 40)))
        assert encode(text) == encoding.encode_ordinary(text), repr(text)


def test_very_long_white_space(spark, encoding):
    n = 1_000_000
    texts = [" " * n, "x" + " " * n + "y\nz", "\n" * 30_000 + "end", "a\n" + "\t \r" * 300_000]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, section string")
    got = defaultdict(list)
    for r in attribution.count_by_line(docs, RANKS, PATTERN).orderBy("section").collect():
        got[r.doc_id].append(r.n_tokens)
    piece = lambda t: len(encoding._encode_single_piece(t))
    assert got[0] == [piece(" " * n)] and got[1] == [1 + piece(" " * (n - 1)) + 1 + 1, 1]
    assert got[2] == slow_counts(encoding, texts[2], slow_bounds(texts[2]), "majority") and got[3] == [2, piece("\t \r" * 300_000)]


def test_fields_add_up(spark, odd_docs, encoding):
    got = attribution.count_by_field(odd_docs.where("doc_id < 10"), ["source", "lang", "text"], RANKS, PATTERN)
    total = got.groupBy("doc_id").sum("n_tokens").collect()
    for r in odd_docs.where("doc_id < 10").collect():
        whole = "\n".join([r.source, r.lang or "", r.text or ""])
        assert dict(map(tuple, total))[r.doc_id] == len(encoding.encode_ordinary(whole))


def test_shards(spark, odd_docs, no_docs):
    docs = spark.range(4000).selectExpr("id AS doc_id", "repeat('é', int(id % 7)) AS text", "'x' AS shard", "id AS slot")
    eight, nine = sharding.balanced_tree(8), sharding.balanced_tree(9)
    got = sharding.layout(docs, eight, nine).collect()
    assert len(got) == 4000
    slots = defaultdict(list)
    for r in got:
        text = "é" * (r.doc_id % 7)
        assert (r.size, r.text_crc32, r.law) == (len(text.encode()) + 1, crc32(text.encode()), "key")
        assert r.grown_shard in (r.shard, 8)
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(400 < len(s) < 600 for s in slots.values()) and 350 < sum(r.grown_shard == 8 for r in got) < 540
    odd = sharding.layout(odd_docs, eight, nine).collect()
    assert len(odd) == odd_docs.count() and len({r.shard for r in odd if r.doc_id is None}) == 1
    assert {r.size for r in odd if r.doc_id == 4} == {1}
    assert sharding.layout(no_docs, eight, nine).count() == 0


def slow_shard(doc_id, tree):
    """The descent, draw by draw: the child with the least -ln(u) / weight, u hashed from its name and the doc_id."""

    def draw(name, weight):
        h = xxhash.xxh64_intdigest(name.encode(), 42)  # hashed one after the other, each with the last as seed
        if doc_id is not None:
            h = xxhash.xxh64_intdigest(doc_id.to_bytes(8, "little", signed=True), h)
        return -math.log(((h >> 11) + 1) / 2**53) / weight, name

    def least(children):
        return min(draw(n, w) for n, w in children.items() if w)[1]

    regions, racks, leaves = defaultdict(float), defaultdict(lambda: defaultdict(float)), defaultdict(dict)
    for s in tree:
        regions[s.region] += s.weight
        racks[s.region][s.rack] += s.weight
        leaves[s.rack][f"{s.rack}/{s.number}"] = s.weight
    return int(least(leaves[least(racks[least(regions)])]).rpartition("/")[2])


def test_draws_equal_brute_force(spark):
    r, ids = random.Random(11), [None, 0, -1, 2**63 - 1, -(2**63)]
    ids += [r.randint(-(2**40), 2**40) for _ in range(400)]
    docs = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    uneven = [sharding.Shard(f"r{k % 3}", f"r{k % 3}/k{k % 2}", k, r.choice([0.0, 0.5, 1.0, 3.0])) for k in range(12)]
    for tree in (sharding.balanced_tree(8), sharding.balanced_tree(9), sharding.balanced_tree(13, 6, 3, 1), uneven):
        got = sharding.assign(docs, tree).collect()
        assert Counter(map(tuple, got)) == Counter((i, slow_shard(i, tree)) for i in ids)


def test_shards_are_written(spark, tmp_path):
    docs, tree = spark.range(100).selectExpr("id AS doc_id", "'t' AS text"), sharding.balanced_tree(4)
    sharding.write_shards(docs, tree, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(tuple, back.select("doc_id", "shard").collect())) == sorted((r.doc_id, r.shard) for r in sharding.assign(docs, tree).collect())


def test_weights_confine_movement(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id")
    tree = sharding.balanced_tree(8)
    more = [sharding.Shard(s.region, s.rack, s.number, 3.0 if s.number == 0 else 1.0) for s in tree]
    before = {r.doc_id: r.shard for r in sharding.assign(docs, tree).collect()}
    after = {r.doc_id: r.shard for r in sharding.assign(docs, more).collect()}
    moved = [(before[i], after[i]) for i in before if before[i] != after[i]]
    # nothing moves between subtrees whose weights stay: not within region 1, nor within rack 1 of region 0
    assert moved and not [m for m in moved if m[0] >= 4 and m[1] >= 4] and not [m for m in moved if {*m} == {2, 3}]
    assert all(m[1] < 4 for m in moved)
    share = Counter(after.values())
    assert 2.5 < share[0] / np.mean([share[k] for k in range(1, 8)]) < 3.5
    assert 7 not in Counter(r.shard for r in sharding.assign(docs, [*tree[:7], sharding.Shard("region1", "region1/rack1", 7, 0.0)]).collect())


def test_fullest_equals_enumeration():
    r = random.Random(3)
    for _ in range(150):
        counts = {r.randint(1, 30): r.randint(1, 4) for _ in range(r.randint(1, 6))}
        room = r.randint(1, 60)
        sums = {0}
        for length, n in counts.items():
            sums = {s + k * length for s in sums for k in range(n + 1) if s + k * length <= room}
        got = packing.fullest(counts, room)
        assert sum(a * n for a, n in got) == max(sums) and all(n <= counts[a] for a, n in got)


def test_plan_places_every_piece():
    r = random.Random(7)
    histogram = Counter(min(100, int(r.paretovariate(1.1) * 3)) for _ in range(5000))
    filled = packing.plan(dict(histogram), 100)
    used = Counter()
    for times, inside in filled:
        assert sum(a * n for a, n in inside) <= 100
        for a, n in inside:
            used[a] += times * n
    assert used == histogram
    least = -(-sum(a * n for a, n in histogram.items()) // 100)
    assert least <= sum(t for t, _ in filled) <= least * 1.02 + 1
    places, taken = packing.Places(filled), defaultdict(list)
    for a, n in histogram.items():
        s, o = places(np.full(n, a), np.arange(n))
        for x, y in zip(s.tolist(), o.tolist(), strict=True):
            taken[x].append((y, a))
    for parts in taken.values():
        at = 0
        for o, a in sorted(parts):
            assert o == at
            at += a
        assert at <= 100


def check_packed(rows, docs, capacity):
    t = Tokenizer.from_file(WORDS)
    want = Counter()
    for i, text in docs:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for k, s in enumerate(range(0, len(ids), capacity)):
            own = ids[s : s + capacity]
            want[(i, k, s, len(own), crc32(own.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def check_sequences(rows, docs, capacity):
    """Each sequence's ids, piece by piece; returns how many sequences there are."""
    pieces = []
    for r in rows:
        ids, at = bytes(r.ids), 0
        assert len(ids) == 4 * r.n_tokens <= 4 * capacity and r.doc_ids == [p.doc_id for p in r.pieces]
        for p in r.pieces:
            assert p.offset == at
            own = ids[4 * at : 4 * (at + p.length)]
            at += p.length
            pieces.append(Row(**p.asDict(), sequence_id=r.sequence_id, ids_crc32=crc32(own)))
        assert at == r.n_tokens
    assert len(rows) == len({r.sequence_id for r in rows})
    return check_packed(pieces, docs, capacity)


def test_packing(spark, odd_docs, no_docs, real, monkeypatch):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    for capacity in (4096, 64):
        check_packed(packing.pack(odd_docs, WORDS, capacity).collect(), docs, capacity)
    rows = packing.pack(real, WORDS).collect()
    n = check_packed(rows, [(r.doc_id, r.text) for r in real.collect()], 4096)
    assert n <= -(-sum(r.length for r in rows) // 4096) + 1
    monkeypatch.setattr(packing, "MAX_BROADCAST_ROWS", 0)  # the same, joined by shuffle
    check_packed(packing.pack(odd_docs, WORDS, 64).collect(), docs, 64)
    assert packing.pack(no_docs, WORDS).count() == 0


def test_sequences_hold_the_ids(spark, odd_docs):
    packed = packing.pack(odd_docs, WORDS, 256, keep_ids=True)
    rows = packed.collect()
    found = packing.sequences(packed).collect()
    whole = {r.sequence_id: bytes(r.ids) for r in found}
    for r in rows:
        assert whole[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids) and crc32(bytes(r.ids)) == r.ids_crc32
    check_sequences(found, [(r.doc_id, r.text) for r in odd_docs.collect()], 256)
    assert packing.sequences(packed.where("false")).count() == 0


def test_remembered_ids_equal_the_tokenizer():
    e, r = packing.Encoder(WORDS), random.Random(0)
    alphabet = "abzé ÀßÿĀſ'’s.!,\n\t  0²½×÷\xa1\xadtll"
    for _ in range(400):
        text = "".join(r.choices(alphabet, k=r.randint(0, 60)))
        assert e(text) == np.array(e.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def holds_an_item(text, sf_dir):
    """At least 0.8 of the five-word shingles of a benchmark item; all items have more words."""
    grams = lambda t: {tuple(w[i : i + 5]) for w in [(t or "").lower().split()] for i in range(len(w) - 4)}
    own = grams(text)
    return any(10 * len(grams(t) & own) >= 8 * len(grams(t)) for t in pq.read_table(f"{sf_dir}/benchmark.parquet")["text"].to_pylist())


def test_pipeline(spark, sf_dir):
    from .test_dedup import slow_components, slow_removal
    from .test_filters import base_counts

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        docs = stage(spark, docs, sf_dir)
        rows = docs.collect()
        if k == 0:
            assert not [r for r in rows if base_counts(r.text)[-1]] and len(rows) < len(before)
        if k == 1:
            assert {r.doc_id for r in rows} == {c for _, _, c in slow_components([(r.doc_id, r.text) for r in before])}
        if k == 2:
            gone = sum(n for _, _, n, _ in slow_removal([(r.doc_id, r.text) for r in before], 35))
            count = lambda rs: sum(len((r.text or "").split()) for r in rs)
            assert len(rows) == len(before) and count(before) - count(rows) == gone
        if k == 3:
            assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in before if not holds_an_item(r.text, sf_dir))
        if k == 4:
            check_sequences(rows, [(r.doc_id, r.text) for r in before], 4096)
        else:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            docs = spark.createDataFrame(rows, docs.schema)


def test_pipeline_drops_what_it_should(spark, sf_dir):
    """Stage 1 keeps what judge() keeps; stage 4 keeps what holds no item."""
    names = ["doc_id", "text"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = lambda df: sorted(map(repr, df.select(names).collect()))
    forest = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = {r.doc_id: r.kept for r in quality.judge(docs, forest).collect()}
    first = corpus_pipeline.STAGES[0][1](spark, docs, sf_dir)
    assert forest is not None and len(kept) == docs.count() and 0 < sum(kept.values()) < len(kept)
    assert rows(first) == sorted(repr(r) for r in docs.select(names).collect() if kept[r.doc_id])

    def grams(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    items = [g for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() if (g := grams(r.text))]
    holds = lambda text: any(10 * len(g & own) >= 8 * len(g) for own in [grams(text)] for g in items)
    every = docs.select(names).collect()
    clean = sorted(repr(r) for r in every if not holds(r.text))
    assert 0 < len(clean) < len(every)
    assert rows(corpus_pipeline.STAGES[3][1](spark, docs, sf_dir)) == clean


def test_stages_take_odd_rows(spark, odd_docs, no_docs, sf_dir):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, sf_dir).count()


def test_every_query_is_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
    assert set(queries.ORACLES) <= set(queries.QUERIES)
