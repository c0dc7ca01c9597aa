"""SimHash, substrings, benchmark items and components."""

import random
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tidelog.llm import components, decontam, queries, simhash, substring

from .conftest import prose, words_of


def slow_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words_of(lower)
    if not w:
        return 0
    h = [xxhash.xxh64(" ".join(w[i : i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(rows, bits=4):
    fps = [slow_fingerprint(t) for _, t in rows]
    kinds = sorted(set(fps))
    root = {x: x for x in kinds}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(kinds):
        for b in kinds[i + 1 :]:
            if (a ^ b).bit_count() <= bits:
                a1, b1 = find(a), find(b)
                root[max(a1, b1)] = min(a1, b1)
    least = {}
    for (i, _), f in zip(rows, fps, strict=True):
        k = find(f)
        if i is not None:
            least[k] = min(i, least.get(k, i))
    return [(i, f"{f:016x}", least.get(find(f))) for (i, _), f in zip(rows, fps, strict=True)]


@pytest.mark.parametrize("which", ["odd_docs", "real"])
def test_simhash_equals_brute_force(request, which):
    docs = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = [tuple(r) for r in simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, slow_components(rows)))


def test_grid_loses_no_link():
    r = random.Random(2)
    fps = [r.getrandbits(64) for _ in range(400)]
    for f in fps[:200]:
        for _ in range(3):
            g = f
            for b in r.sample(range(64), r.randint(1, 6)):
                g ^= 1 << b
            fps.append(g)
    fps += [f ^ 1 << b for f in fps[:2] for b in range(64)]  # dense groups
    x = np.unique(np.array(fps, np.uint64))
    rows, cells = simhash.grid_cells(x)
    order = np.argsort(cells, kind="stable")
    a, b = simhash.cell_links(cells[order], x[rows][order])
    assert (np.bitwise_count(a ^ b) <= 4).all()

    def classes(pairs):
        root = {int(v): int(v) for v in x}

        def find(v):
            while root[v] != v:
                v = root[v]
            return v

        for p, q in pairs:
            p, q = find(int(p)), find(int(q))
            root[max(p, q)] = min(p, q)
        return {v: find(v) for v in root}

    near = [(p, q) for i, p in enumerate(x) for q in x[i + 1 :][np.bitwise_count(x[i + 1 :] ^ p) <= 4]]
    assert classes(zip(a, b, strict=True)) == classes(near) and len(near) > 600


def test_popcounts_bound_hamming_distance():
    r = np.random.default_rng(0)
    a, b = (r.integers(0, 2**63, 5000).astype(np.uint64) for _ in range(2))
    parts = [(v - ((v >> np.uint64(1)) & np.uint64(0x5555555555555555)))[:, None] >> np.arange(0, 64, 2).astype(np.uint64) & np.uint64(3) for v in (a, b)]
    manhattan = np.abs(parts[0].astype(int) - parts[1].astype(int)).sum(1)
    assert (manhattan <= np.bitwise_count(a ^ b)).all()


def test_large_cells_are_spanned_without_pairs():
    r = random.Random(1)
    centre = r.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in r.sample(range(64), 2)) for _ in range(900)} | {centre}
    found = simhash._forest(np.array(sorted(fps), np.uint64), 4)
    assert sum(len(b) for _, b in found) == len(fps) - 1


def test_large_cells_are_split_without_loss(spark):
    r = random.Random(8)
    fps = {r.getrandbits(64) ^ 0 for _ in range(100)}
    for centre in list(fps)[:3]:
        fps |= {centre ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 3))) for _ in range(120)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    df = spark.createDataFrame(signed, "fp long")
    found = []
    for how in ({}, {"large": 20, "sample": 1}):
        roots = components.connected_components(simhash.links(df, **how))
        found.append({x.node: x.root for x in roots.collect()})
    assert found[0] == found[1] and len(found[0]) > 300


def test_one_document_of_each_component_stays(odd_docs, real, no_docs):
    for docs in (odd_docs, real, no_docs):
        component = {f: c for _, f, c in slow_components([(r.doc_id, r.text) for r in docs.collect()])}
        kept = simhash.keep_one(docs)
        assert kept.columns == docs.columns
        got = slow_components([(r.doc_id, r.text) for r in kept.collect()])
        assert len({f for _, f, _ in got}) == len(got)  # no row twice
        assert all(i == component[f] for i, f, _ in got)  # each has its component's id
        assert {component[f] for _, f, _ in got} == set(component.values())  # no component is lost


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    r = random.Random(seed)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(500, i) for i in range(501, 540)]
    pairs += [(7, 7), (None, 3)]
    got = {x.node: x.root for x in components.connected_components(spark.createDataFrame(pairs, "x long, y long")).collect()}
    root = {}

    def find(v):
        root.setdefault(v, v)
        while root[v] != v:
            v = root[v]
        return v

    for a, b in pairs:
        if None not in (a, b) and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert got == {v: find(v) for v in root}
    assert components.connected_components(spark.createDataFrame([], "x long, y long")).count() == 0


def test_a_hub_of_all_nodes_is_split(spark, tmp_path):
    """One node with all links: Spark deals its rows out to several tasks, in both steps."""
    for name, pairs in (("star", ["id AS a", "0L AS b"]), ("hub", ["70000L AS a", "id AS b"])):
        spark.range(1, 60_001).selectExpr(*pairs).repartition(8).write.parquet(f"{tmp_path}/{name}")
    star, hub = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("star", "hub"))
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        for step, links, root in ((components._large_star, star, 0), (components._small_star, hub, 1)):
            found = step(links)
            rows = found.collect()
            assert len(rows) == 60_000 and {r.b for r in rows} == {root}
            assert "skew=true" in found._jdf.queryExecution().executedPlan().toString(), root
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def slow_removal(rows, width):
    seen, split = {}, [(i, words_of(t)) for i, t in rows]
    for _, w in split:
        for s in range(len(w) - width + 1):
            k = tuple(w[s : s + width])
            seen[k] = seen.get(k, 0) + 1
    out = []
    for i, w in split:
        gone = set()
        for s in range(len(w) - width + 1):
            if seen[tuple(w[s : s + width])] > 1:
                gone.update(range(s, s + width))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("which", ["odd_docs", "real", "no_docs"])
def test_substrings_equal_brute_force(request, which):
    docs = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = substring.digest(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, slow_removal(rows, 35)))


def test_substrings_of_random_words(spark):
    """Few words and short windows: every kind of overlap and period."""
    for seed, vocabulary in ((0, 2), (1, 3), (2, 5)):
        r = random.Random(seed)
        rows = [(i, " ".join(r.choices("abcde"[:vocabulary], k=r.randint(0, 25)))) for i in range(25)]
        rows += [(40, "a b a b a b a b a b a b"), (41, "c d e " * 6)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        for skew in ({}, {"max_rows": 2, "sample": 1}):
            got = substring.digest(docs, window=6, gram=3, **skew).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
            assert sorted(map(tuple, got)) == sorted(slow_removal(rows, 6))


def test_windows_on_hot_anchors_are_counted_one_by_one(spark, odd_docs, monkeypatch):
    """One gram in every document, in different surroundings, and passages that many share."""
    r = random.Random(3)
    gram, passage = "one gram of eight words that all share", prose(r, 45)
    rows = [(i if i % 9 else None, f"{prose(r, r.randint(0, 40))} {gram} {prose(r, r.randint(30, 60))}") for i in range(120)]
    rows += [(200 + i, f"{prose(r, 5)} {passage} {gram} {prose(r, 20)}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = sorted(map(repr, slow_removal(rows, 35)))
    widest = []
    for max_rows in (10**9, 20):
        got = substring.digest(docs, max_rows=max_rows, sample=1).select("doc_id", "n_words", "n_removed", "kept_sha256")
        assert sorted(map(repr, map(tuple, got.collect()))) == want
        keyed = substring._keyed(docs)
        hot = substring._hot_anchors(keyed, 35, 8, max_rows, 1)
        runs = substring._run_rows(keyed, 35, 8, hot)
        widest.append(runs.groupBy("anchor").count().agg({"count": "max"}).first()[0])
        assert bool(len(hot)) == (max_rows == 20)
    assert widest[0] > 50 and widest[1] <= 20
    monkeypatch.setattr(substring, "MAX_HOT", 3)
    assert len(substring._hot_anchors(keyed, 35, 8, 0, 1)) == 3
    odd = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = substring.digest(odd_docs, max_rows=0, sample=1).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, slow_removal(odd, 35)))


def test_blocks_count_equal_rows(monkeypatch):
    monkeypatch.setattr(substring, "BLOCK", 8)
    blocks, found = substring._Blocks(["start", "h"], ["h"]), []
    ids = pa.RecordBatch.from_arrays([pa.array([1, None]), pa.array([5, 6])], names=["doc_id", "key"])
    for h in ([7, 7, 8], [7, 9], [7, 8, 9, 7], [7]):
        h = np.array(h, np.uint64)
        found += blocks.add(ids, np.arange(len(h)) % 2, np.arange(len(h), dtype=np.int32), h)
    found += blocks.flush()
    got = [r for b in found for r in b.to_pylist()]
    assert len(got) == 10 and [r["doc_id"] for r in got[:4]] == [1, None, 1, 1]
    # nine rows in one block, one in the next; what is counted has its sum, the rest is proven under keys of its own
    assert sorted((r["h"], r["count"]) for r in got if r["h"] in (7, 8, 9)) == [(7, 1), (7, 5), (8, 2), (9, 2)]
    rest = [r for r in got if r["h"] not in (7, 8, 9)]
    assert [r["count"] for r in rest] == [2] * 6 and len({r["h"] for r in rest}) == 6


def test_substring_sql(spark, sf_dir, same):
    same(queries.op6_substring_dedup(spark, sf_dir), queries.ORACLES["op6_substring_dedup"])


def test_removal_keeps_rows_and_white_space(spark, odd_docs, no_docs):
    done = substring.remove_repeats(odd_docs)
    assert done.columns == odd_docs.columns and done.count() == odd_docs.count()
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    want = sorted((repr(i), h) for i, _, _, h in slow_removal(rows, 35))
    got = sorted((repr(r.doc_id), sha256(" ".join(words_of(r.text)).encode()).hexdigest()) for r in done.collect())
    assert got == want
    assert all(r.n_chars == len(r.text) if r.text is not None else r.n_chars is None for r in done.collect())
    assert substring.remove_repeats(no_docs).count() == 0
    assert substring.cut_text(b"a  b\nc d\te", [(1, 3)]) == b"a  d\te" and substring.cut_text(b" a b ", [(0, 2)]) == b" "


def test_intervals():
    of = lambda *s: substring.intervals(np.array([a for a, _ in s]), np.array([n for _, n in s]), 5)
    assert of() == [] and of((0, 1), (5, 1)) == [(0, 10)] and of((6, 1), (0, 1)) == [(0, 5), (6, 11)]
    assert of((0, 10), (2, 1), (20, 2)) == [(0, 14), (20, 26)]


def test_benchmark_items_equal_their_sql(spark, sf_dir, same):
    same(queries.op3_decontamination(spark, sf_dir), queries.ORACLES["op3_decontamination"])


def test_search_both_ways_and_at_the_threshold(spark, odd_docs, no_docs):
    r = random.Random(9)
    item = prose(r, 24)  # 20 shingles
    w = item.split()
    near = " ".join([*w[:20], "changed"])  # 16 of 20 shingles: just enough
    far = " ".join([*w[:19], "changed"])
    docs = spark.createDataFrame(
        [(1, prose(r, 300) + " " + item.upper() + "\n" + prose(r, 300)), (2, near), (3, far), (4, "one two three four"), (None, item), (1, item), (6, None)],
        "doc_id long, text string",
    )
    items = spark.createDataFrame([(1, item), (2, item), (3, None), (4, "short one"), (5, ""), (None, w and prose(r, 40))], "item_id long, text string")
    want = sorted([(d, i) for d in (1, 2, 1, None) for i in (1, 2)], key=repr)
    small = decontam.search(docs, items)
    large = decontam.search(docs, items, max_items=0)
    assert sorted([(x.doc_id, x.item_id) for x in small.collect()], key=repr) == want
    assert sorted(map(repr, large.collect())) == sorted(map(repr, small.collect()))
    for how in ({}, {"max_items": 0}):
        clean = decontam.filter_contaminated(docs, items, **how)
        assert sorted(x.doc_id for x in clean.collect()) == [3, 4, 6]
    assert decontam.filter_contaminated(odd_docs, items).columns == odd_docs.columns
    assert sorted(map(repr, decontam.filter_contaminated(odd_docs, items).collect())) == sorted(map(repr, odd_docs.collect()))
    assert decontam.search(no_docs, items).count() == 0 and decontam.search(docs, items.where("false")).count() == 0


def test_both_ways_judge_each_row_by_its_own_text(spark):
    r = random.Random(12)
    held, unnamed, other = prose(r, 24), prose(r, 30), prose(r, 26)
    texts = [(None, held), (None, prose(r, 50)), (None, None), (7, held), (7, prose(r, 40)), (8, unnamed), (8, other), (9, "short"), (7, held)]
    docs = spark.createDataFrame([(i, t, k, "n") for k, (i, t) in enumerate(texts)], "doc_id long, text string, key int, near string")
    # a null item, and two items of one id
    items = spark.createDataFrame([(1, held), (None, unnamed), (2, other), (2, prose(r, 20)), (None, None)], "item_id long, text string")
    small = sorted(map(repr, decontam.search(docs, items).collect()))
    want = sorted([(None, 1), (7, 1), (7, 1), (8, None), (8, 2)], key=repr)
    for how in ({}, {"max_items": 0}, {"max_bytes": 0}):
        found = decontam.search(docs, items, **how).collect()
        assert sorted([(x.doc_id, x.item_id) for x in found], key=repr) == want and sorted(map(repr, found)) == small
        clean = decontam.filter_contaminated(docs, items, **how)
        assert clean.columns == docs.columns and sorted(x.key for x in clean.collect()) == [1, 2, 4, 7]


def slow_search(docs, items):
    """Shingles of as many words as the item has, five at most; all against all."""
    split = lambda t: (t or "").lower().split()
    grams = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    found = []
    for item_id, text in items:
        w = split(text)
        k = min(5, len(w))
        mine = grams(w, k) if k else set()
        for doc_id, t in docs:
            n = len(mine & grams(split(t), k)) if mine else 0
            if mine and 10 * n >= 8 * len(mine):
                found.append((doc_id, item_id, len(mine), n, n / len(mine)))
    return sorted(map(repr, found))


def test_short_and_equal_items_equal_brute_force(spark, odd_docs, no_docs):
    r = random.Random(21)
    long = prose(r, 2000)
    w = long.split()
    docs = [(1, long), (2, "a b c"), (2, "x a b c d y"), (None, "Yes"), (None, "yes no"), (3, "A\tB\nC"), (4, None), (5, ""), (6, "a c b"), (6, "a c b"), (7, "a b c d e f")]
    items = [(1, "a b c"), (2, "yes"), (None, "YES no"), (3, " ".join(w[700:704])), (4, " ".join(w[900:903])), (5, "a b c"), (5, "b c d e f"), (6, ""), (7, None), (8, " "), (9, "nowhere")]
    items += [(10 + i, " ".join(w[100 * i : 100 * i + r.randint(5, 40)])) for i in range(8)] + [(30, "a b c")]
    df, of = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = slow_search(docs, items)
    assert len(want) > 25
    for how in ({}, {"max_items": 0}):
        assert sorted(map(repr, map(tuple, decontam.search(df, of, **how).collect()))) == want
        clean = [r.text for r in decontam.filter_contaminated(df, of, **how).collect()]
        assert sorted(map(repr, clean)) == sorted(map(repr, [None, "", "a c b", "a c b"]))
        odd = decontam.search(odd_docs, of, **how).collect()
        assert sorted(map(repr, map(tuple, odd))) == slow_search([(x.doc_id, x.text) for x in odd_docs.collect()], items)
        assert decontam.search(no_docs, of, **how).count() == 0 == decontam.search(df, of.where("false"), **how).count()
        assert decontam.filter_contaminated(odd_docs, of.where("item_id > 100"), **how).count() == odd_docs.count()


def test_benchmark_sql_finds_short_items(spark, same, duck):
    """The query's SQL and the operator agree on items of any length."""
    docs = [(1, "a b c d e f g"), (2, "c d"), (3, None), (4, "q")]
    items = [(1, "b c"), (2, "C D"), (3, "q"), (4, "a b c d e f"), (5, ""), (6, None), (7, "a b c d e f x")]
    df, of = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    quoted = lambda rows: ", ".join(f"({i}, {'NULL' if t is None else repr(t)})" for i, t in rows)
    sql = queries.ORACLES["op3_decontamination"].replace("FROM documents", f"FROM (VALUES {quoted(docs)}) v(doc_id, text)")
    same(decontam.search(df, of), sql.replace("FROM benchmark", f"FROM (VALUES {quoted(items)}) v(item_id, text)"))


def test_bitmap_keeps_every_value(spark):
    r = np.random.default_rng(3)
    for n in (0, 1, 70, 5000):
        v = r.integers(-(2**63), 2**63 - 1, n)
        bitmap = decontam._bitmap(spark.createDataFrame([(int(x),) for x in v], "value long"))
        other = r.integers(0, 2**63, 10_000).astype(np.uint64)
        assert len(decontam._among(v.view(np.uint64), bitmap)) == n and len(decontam._among(other, bitmap)) < 1500


def test_sketches_lose_nothing():
    r = random.Random(4)
    memory = decontam._WordHashes()
    for _ in range(200):
        w = prose(r, r.randint(5, 60)).encode().split()
        h = np.unique(decontam.min_hashes(w, memory))
        need = decontam.needed(len(h), 0.8)
        left = set(r.sample(h.tolist(), need))
        assert left & set(decontam.sketch(h, 0.8).tolist())
