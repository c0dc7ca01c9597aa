"""Quality rules, toxicity, language and URLs."""

from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import common, langid, quality, queries, toxicity, urlfilter

from .conftest import words_of


def base_counts(text):
    words, lines = words_of(text), (text or "").split("\n")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen, inside = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            inside.update(range(i, i + 5))
    with_word = [x for x in lines if words_of(x)]
    n, rep = len(words), len(inside)
    dup = len(with_word) - len(set(with_word))
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, rep, n < 10 or 100 * rep > 20 * n


@pytest.mark.parametrize("which", ["odd_docs", "real"])
def test_base_counts_equal_brute_force(request, which):
    docs = request.getfixturevalue(which)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = quality.judge(docs, None).select("doc_id", *names, "kept").collect()
    want = [(r.doc_id, *(c := base_counts(r.text)), not c[-1]) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_forest_learns_and_keeps_its_constraints():
    r = np.random.default_rng(3)
    x = r.uniform(size=(3000, 3))
    y = ((x[:, 0] > 0.5) ^ (r.uniform(size=3000) < 0.05)).astype(float)
    f = quality.fit_forest(x, y, [1, -1, 0], trees=30)
    assert ((f.probability(x) > 0.5) == (x[:, 0] > 0.5)).mean() > 0.97
    grid = np.tile(r.uniform(size=(200, 1, 3)), (1, 50, 1))
    for feature, sign in ((0, 1), (1, -1)):
        g = grid.copy()
        g[:, :, feature] = np.linspace(0, 1, 50)
        assert (sign * np.diff(f.log_odds(g.reshape(-1, 3)).reshape(200, 50), axis=1) >= -1e-12).all()


def slow_tree(x, y, monotone, depth, bins, least, l2):
    """One tree, node by node: every statistic, every edge, gains from the rows themselves."""
    share = y.mean()
    p = np.full(len(y), share)
    grad, hess, found = p - y, p * (1 - p), {}
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]

    def worth(rows, low, high):
        g, h = grad[rows].sum(), hess[rows].sum() + l2
        v = float(np.clip(-g / h, low, high))
        return v, -(g * v + 0.5 * h * v * v)

    def grow(node, rows, low, high, value):
        found[node] = value
        if node >= 2**depth - 1:
            return
        best = None
        for f, cuts in enumerate(edges):
            for c in cuts:
                a, b = rows & (x[:, f] <= c), rows & (x[:, f] > c)
                if hess[a].sum() < least or hess[b].sum() < least:
                    continue
                (va, wa), (vb, wb) = worth(a, low, high), worth(b, low, high)
                gain = wa + wb - worth(rows, low, high)[1]
                if (vb - va) * monotone[f] >= 0 and gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, f, a, b, va, vb)
        if best is None:
            for child in (2 * node + 1, 2 * node + 2):
                grow(child, rows if child % 2 else rows & False, low, high, value)
            return
        _, f, a, b, va, vb = best
        middle = (va + vb) / 2
        grow(2 * node + 1, a, *((low, middle) if monotone[f] > 0 else (middle, high) if monotone[f] < 0 else (low, high)), va)
        grow(2 * node + 2, b, *((middle, high) if monotone[f] > 0 else (low, middle) if monotone[f] < 0 else (low, high)), vb)

    grow(0, np.ones(len(y), bool), -np.inf, np.inf, worth(np.ones(len(y), bool), -np.inf, np.inf)[0])
    return found


@pytest.mark.parametrize("seed", range(4))
def test_a_tree_grows_as_by_brute_force(seed):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(300, 4)), 2)
    y = (x[:, 0] - x[:, 1] * x[:, 2] + r.normal(size=300) > 0).astype(float)
    monotone = [1, -1, 0, 1]
    f = quality.fit_forest(x, y, monotone, trees=1, depth=3, rate=1.0, bins=8, least=2.0, l2=1.0)
    want = slow_tree(x, y, monotone, 3, 8, 2.0, 1.0)
    assert all(abs(f.value[0, k] - v) < 1e-9 for k, v in want.items())
    assert np.isfinite(f.threshold[0]).sum() >= 3


def test_forest_equals_walking_its_trees():
    r = np.random.default_rng(4)
    x = r.normal(size=(500, 4))
    f = quality.fit_forest(x, (x[:, 0] * x[:, 1] > 0).astype(float), [0] * 4, trees=10)
    for row in x[:50]:
        total = f.base
        for t in range(10):
            at = 0
            for _ in range(f.depth):
                at = 2 * at + 1 + (row[f.statistic[t, at]] > f.threshold[t, at])
            total += f.value[t, at]
        assert abs(total - f.log_odds(row[None])[0]) < 1e-12


def test_quality_follows_the_labels(spark):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = queries.op1_quality_rules(spark, d).where("not base_failed").collect()
    known = [(r.kept, labels[r.doc_id]) for r in got if r.doc_id in labels]
    assert np.mean([k == bool(q) for k, q in known]) > 0.98


def test_quality_on_held_out_documents(spark):
    """Labels of the held-out quarter teach nothing, and are followed all the same."""
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    wrong = labels.withColumn("quality", F.when(common.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    docs = spark.read.parquet(f"{d}/documents.parquet")
    a, b = quality.fit_quality(docs, labels), quality.fit_quality(docs, wrong)
    assert (a.value == b.value).all() and (a.threshold == b.threshold).all()
    known = {r.doc_id: r.quality for r in labels.where(common.held_out(F.col("doc_id"))).collect()}
    got = [(r.kept, known[r.doc_id]) for r in quality.judge(docs, a).where("not base_failed").collect() if r.doc_id in known]
    assert len(got) > 40 and np.mean([k == bool(q) for k, q in got]) > 0.95


def test_base_counts_equal_their_sql(spark, sf_dir, same):
    same(queries.quality_base_counts(spark, sf_dir), queries.ORACLES["quality_base_counts"])


def test_quality_filter_keeps_rows_whole(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    kept = quality.filter_quality(odd_docs, labels)
    assert kept.schema.names == odd_docs.schema.names
    want = [r for r in odd_docs.collect() if not base_counts(r.text)[-1]]
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, want))
    assert quality.filter_quality(no_docs, labels).count() == 0 and quality.judge(no_docs, None).count() == 0
    one = spark.createDataFrame([(1, 1, 0), (None, 0, 1), (2, None, None), (1, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.fit_quality(odd_docs, one) is None


def test_samples_keep_rare_labels(spark):
    rows = spark.range(20_000).selectExpr("id AS doc_id", "concat('t', id) AS text", "if(id % 4000 = 7, 'rare', 'usual') AS label")
    rows = rows.union(spark.range(4000).selectExpr("CAST(null AS LONG)", "concat('null ', id)", "'unnamed'"))
    got = Counter(r.label for r in common.bounded_sample(rows, ["doc_id", "text"], 1000, "label").collect())
    # about 833 and 167 in proportion; all of the five; null ids are chosen one by one
    assert got["rare"] == 5 and 700 < got["usual"] < 970 and 140 < got["unnamed"] < 260
    assert common.bounded_sample(rows, ["doc_id", "text"], 24_000, "label").count() == 24_000


def test_rare_classes_are_learned(spark):
    n = 14_000
    # documents that a sample in proportion to the labels takes one in two or three of; one in 2,000 is rare
    base = spark.range(n).selectExpr("id AS doc_id", "id % 2000 = 1 AS rare")
    docs = base.selectExpr("doc_id", "if(rare, 'zyx wvu zyx wvu', 'the cat sat there') AS text", "if(rare, 'zz', 'en') AS lang")
    ids = {r.doc_id for r in base.where("rare").collect() if crc32(str(r.doc_id).encode()) % 4 != 2}
    model = langid.fit_language(docs, max_docs=500)
    count = sum(int(c) for k, g, c in zip(model.language, model.gram, model.count, strict=True) if model.languages[k] == "zz" and g & 255 == ord("v"))
    assert model.languages == ["en", "zz"] and count == 2 * len(ids)
    labels = base.selectExpr("doc_id", "int(NOT rare) AS quality", "int(rare) AS toxic")
    tox = toxicity.fit_toxicity(docs, labels, max_docs=500)
    assert {r.predicted for r in toxicity.score(docs.where("lang = 'zz'"), tox).collect()} == {1}
    assert quality.fit_quality(docs, labels, max_rows=500, trees=2) is not None


def test_toxicity_slopes_equal_differences():
    """The gradient against the definition: P(toxic) = 1 - prod(1 - p_s), mean negative log-likelihood."""
    r = np.random.default_rng(5)
    sizes = r.integers(1, 6, 30)
    doc_of, doc_at = np.repeat(np.arange(30), sizes), np.cumsum(sizes) - sizes
    y, z = (r.uniform(size=30) < 0.4).astype(float), r.normal(-1, 2, sizes.sum())

    def loss(z):
        p = [1 - np.prod(1 - 1 / (1 + np.exp(-z[a : a + n]))) for a, n in zip(doc_at, sizes, strict=True)]
        return -np.mean(np.where(y > 0, np.log(p), np.log1p(-np.array(p))))

    got = toxicity.sentence_slopes(z, y, doc_at, doc_of)
    for j in range(len(z)):
        step = np.eye(len(z))[j] * 1e-5
        assert abs((loss(z + step) - loss(z - step)) / 2e-5 - got[j]) < 1e-6


def test_toxicity_learns_from_bags():
    """Words that make a document toxic get weights, words beside them none; settings are compared on folds."""
    r = np.random.default_rng(6)
    bags = []
    for _ in range(400):
        bad = r.uniform() < 0.3
        sentences = [r.integers(10, 60, 6).astype(np.uint32) for _ in range(r.integers(1, 6))]
        if bad:
            sentences[0] = np.append(sentences[0], np.uint32(r.integers(0, 3)))
        bags.append((int(bad), sentences))
    assert toxicity.cross_validated(bags)["misses"] < 12 and toxicity.cross_validated(bags, steps=1)["log_loss"] > toxicity.cross_validated(bags)["log_loss"]
    model = toxicity.fit(bags)
    weights = [model.weights.get(k, 0.0) for k in range(60)]
    assert min(weights[:3]) > 3 and max(weights[10:]) < 1.5


def test_toxicity_on_held_out_documents(spark):
    d = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = queries.op2_toxicity(spark, d).select("doc_id", "held_out", "score", "predicted").collect()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) for r in got)
    known = [(r.score, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    s, y = map(np.array, zip(*known, strict=True))
    rank = np.empty(len(s))
    rank[np.argsort(s)] = np.arange(len(s))
    auc = (rank[y == 1].mean() - (y.sum() - 1) / 2) / (y == 0).sum()
    assert auc > 0.95 and ((s >= 0.3) == (y == 1)).mean() > 0.97


def test_noisy_or_and_location(spark, odd_docs, no_docs):
    model = toxicity.Model({f: 12.0 for f in toxicity.features("vile")}, -8.0)
    docs = spark.createDataFrame(
        [(1, "All is well. You are VILE, you.\nFine!"), (2, "All well."), (3, None), (4, ""), (None, "vile")], "doc_id long, text string"
    )
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    p = [1 / (1 + np.exp(-z)) for z in (-8, 4, -8)]
    assert abs(got[1].score - (1 - np.prod([1 - x for x in p]))) < 1e-12
    assert got[1].predicted == 1 and got[2].predicted == 0 and got[3].score == got[4].score == 0 and got[None].predicted == 1
    where = [(r.doc_id, r.sentence) for r in toxicity.locate(docs, model).collect()]
    assert where == [(1, " You are VILE, you"), (None, "vile")]
    assert toxicity.score(no_docs, model).count() == 0 and toxicity.locate(no_docs, model).count() == 0
    assert toxicity.score(odd_docs, model).count() == odd_docs.count()
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 1)], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score(odd_docs, toxicity.fit_toxicity(odd_docs, labels)).collect()} == {0.0}


def ppm_bits(model, k, text):
    """PPM with method C and exclusion, byte by byte, straight from the definition."""
    tables = [{} for _ in range(4)]
    for lang, g, n in zip(model.language, model.gram, model.count, strict=True):
        if lang == k:
            b = int(g).to_bytes(4, "big")
            for w in range(4):
                c = tables[w].setdefault(b[3 - w : 3], {})
                c[b[3]] = c.get(b[3], 0) + int(n)
    total, data = 0.0, b"\n\n\n" + text
    for i in range(3, len(data)):
        s, out = data[i], set()
        for w in (3, 2, 1, 0):
            c = {x: n for x, n in tables[w].get(data[i - w : i], {}).items() if x not in out}
            if not c:
                continue
            n, d = sum(c.values()), len(c)
            if s in c:
                total -= np.log2(c[s] / (n + d))
                break
            total -= np.log2(d / (n + d))
            out |= set(c)
        else:
            total += np.log2(256 - len(tables[0].get(b"", {})))
    return total


def test_code_lengths_equal_ppm(spark, real):
    model = langid.fit_language(real, max_docs=60)
    made = langid.Coder(model)
    r = np.random.default_rng(1)
    texts = [x.text.encode()[:400] for x in real.limit(4).collect()] + [b"x", "日本語 \U0001f600".encode(), bytes(r.integers(32, 127, 60).tolist())]
    got = made.bits(texts)
    for i, t in enumerate(texts):
        want = [ppm_bits(model, k, t) for k in range(len(model.languages))]
        assert np.allclose(got[i], want, rtol=1e-5)


def test_code_lengths_equal_ppm_with_many_scripts(spark, monkeypatch):
    r = np.random.default_rng(2)
    scripts = {"en": (33, 127), "la": (0xA0, 0x250), "el": (0x3B1, 0x3CA), "ru": (0x430, 0x450), "hy": (0x561, 0x587), "ka": (0x10D0, 0x10F1), "th": (0xE01, 0xE2F), "ja": (0x4E00, 0x9F00), "ko": (0xAC00, 0xD7A0), "xx": (0x10000, 0x10FFFF)}
    word = lambda a, b, n: "".join(map(chr, r.integers(a, b, n)))
    texts = {k: " ".join(word(a, b, 5) for _ in range(60)) for k, (a, b) in scripts.items()}
    docs = spark.createDataFrame([(None, t, k) for k, t in texts.items()], "doc_id long, text string, lang string")
    model = langid.fit_language(docs)
    assert model.languages == sorted(scripts) and len(np.unique(model.gram & 255)) > 127
    asked = [t.encode()[:150] for t in texts.values()] + [(word(a, b, 6) + "\t" + word(a, b, 9)).encode() for a, b in scripts.values()] + [bytes(range(256))]
    want = [[ppm_bits(model, k, t) for k in range(len(model.languages))] for t in asked]
    made = langid.Coder(model)
    assert np.allclose(made.bits(asked), want, rtol=1e-5) and np.allclose(made.bits(asked[::-1]), want[::-1], rtol=1e-5)
    monkeypatch.setattr(langid, "MEMORY", 10 * 150)  # the memory starts anew again and again
    for t, w in zip(asked, want, strict=True):
        assert np.allclose(made.bits([t])[0], w, rtol=1e-5)


def test_languages_of_held_out_documents(spark, odd_docs, no_docs):
    d = "/root/testdata/sf0.01"
    known = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = queries.op9_language_id(spark, d).collect()
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == known[r.doc_id] for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in got)
    model = langid.fit_language(odd_docs)
    assert model.languages == ["en"]
    und = {(r.doc_id, r.lang_pred) for r in langid.identify(odd_docs, model).collect() if r.lang_pred != "en"}
    assert und == {(4, "und"), (5, "und"), (6, "und"), (None, "und")}
    empty = langid.fit_language(no_docs)
    assert {r.lang_pred for r in langid.identify(odd_docs, empty).collect()} == {"und"}
    assert langid.identify(no_docs, model).count() == 0


def test_urls_equal_their_sql(spark, sf_dir, same):
    same(queries.op10_url_filter(spark, sf_dir), queries.ORACLES["op10_url_filter"])


def test_url_rules(spark):
    rules = [urlfilter.Rule.parse(r) for r in queries.URL_RULES]
    urls = {
        "https://A.Example.COM/en/x?y": ("a.example.com", "/en/x", "example.com/en/", "block"),
        "http://www.example.com/en/#t": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://x.www.example.com/en/1": ("x.www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "http://com/": ("com", "/", "com/", "allow"),
        "http://notcom/": ("notcom", "/", None, None),
        "http://x.net/es/1": ("x.net", "/es/1", "net/es/", "block"),
        "http://x.com?q=/": ("x.com", "", None, None),
        "no scheme.com/": ("", "", None, None),
        "a://b://c.com/": ("b:", "//c.com/", None, None),
        "://": ("", "", None, None), "": ("", "", None, None), None: ("", "", None, None),
        "http://ü.com/É\n?": ("ü.com", "/É\n", "com/", "allow"),
    }
    pages = spark.createDataFrame([(i, u, "h", "k", 0.1) for i, u in enumerate(urls)] * 2, "page_id long, url string, host string, u string, score double")
    got = urlfilter.judge(pages, rules).collect()
    assert len(got) == 2 * len(urls)
    for r, (u, want) in zip(sorted(got, key=lambda r: r.page_id)[::2], urls.items(), strict=True):
        assert (r.host, r.path, r.rule) == want[:3], u
        assert r.verdict == want[3] if want[3] else r.verdict in ("allow", "block")
    shuffled = urlfilter.judge(pages, rules, max_broadcast_rows=0).collect()
    assert sorted(map(repr, shuffled)) == sorted(map(repr, got))
    assert urlfilter.judge(pages.where("false"), rules).count() == 0
    only = urlfilter.judge(pages.where("page_id = 4"), rules).collect()
    assert [r.verdict for r in only] == ["allow", "allow"] and only[0].score is None
