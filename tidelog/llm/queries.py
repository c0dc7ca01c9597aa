"""The registered queries of the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import attribution, decontam, langid, packing, quality, sharding, simhash, substring, toxicity, urlfilter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit_quality(docs, _table(spark, sf_dir, "labels")))


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op1 counts before its forest judges."""
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return quality.judge(_table(spark, sf_dir, "documents"), None).select("doc_id", *counts)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit_toxicity(docs, _table(spark, sf_dir, "labels")))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return attribution.count_by_line(_table(spark, sf_dir, "documents"), path, pattern)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(_table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return sharding.layout(docs, sharding.balanced_tree(8), sharding.balanced_tree(9))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit_language(docs))


#: As they come: the verdict and where it holds.
URL_RULES = ["allow com/", "block example.com/en/", "allow www.example.com/en/", "block net/es/", "block net/fr/"]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [urlfilter.Rule.parse(r) for r in URL_RULES]
    found = urlfilter.judge(_table(spark, sf_dir, "pages"), rules)
    return found.select("page_id", "host", "path", "rule", "verdict")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_toxicity": op2_toxicity,
    "op3_decontamination": op3_decontamination,
    "op4_token_counts": op4_token_counts,
    "op5_simhash": op5_simhash,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_sharding": op7_sharding,
    "op8_packing": op8_packing,
    "op9_language_id": op9_language_id,
    "op10_url_filter": op10_url_filter,
    "quality_base_counts": quality_base_counts,
}

ORACLES: dict[str, str] = {}

ORACLES["quality_base_counts"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
           FROM documents),
     x AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
     y AS (SELECT r, i FROM x QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
     p AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM y) GROUP BY r),
     c AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
                  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
           FROM d LEFT JOIN p USING (r))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c
"""

ORACLES["op3_decontamination"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents),
     b AS (SELECT item_id, w, least(len(w), 5) AS k
           FROM (SELECT item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM benchmark) WHERE len(w) > 0),
     bs AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
            FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
     ds AS (SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
            FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM b))),
     n AS (SELECT item_id, count(*) AS n_item_shingles FROM bs GROUP BY item_id),
     m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (k, s) GROUP BY ALL)
SELECT doc_id, item_id, n_item_shingles, n_shared, n_shared::DOUBLE / n_item_shingles AS containment
FROM m JOIN n USING (item_id) WHERE 10 * n_shared >= 8 * n_item_shingles
"""

ORACLES["op6_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
     x AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h
           FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
     r AS (SELECT h FROM x GROUP BY h HAVING count(*) > 1),
     c AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM x SEMI JOIN r USING (h))),
     l AS (SELECT doc_id, list(p) AS ps FROM c GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(len(ps), 0) AS n_removed,
       sha256(array_to_string(CASE WHEN ps IS NULL THEN w
         ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda z: NOT list_contains(ps, z[2])),
                             lambda z: z[1]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN l USING (doc_id)
"""


def _level(width: int) -> str:
    """SQL of the counts and the smoothed probabilities of one context length."""
    shorter = f"right(t.c, {width - 1}) = q.c AND t.s = q.s" if width > 1 else "t.s = q.s"
    return f"""
     t{width} AS (SELECT *, sum(a) OVER w AS na, sum(b) OVER w AS nb,
                         count(*) FILTER (a > 0) OVER w AS da, count(*) FILTER (b > 0) OVER w AS db
                  FROM (SELECT right(c, {width}) AS c, s, sum(a) AS a, sum(b) AS b FROM cnt GROUP BY ALL)
                  WINDOW w AS (PARTITION BY c)),
     p{width} AS (SELECT t.c, t.s, CASE WHEN na > 0 THEN (a + da * pa) / (na + da) ELSE pa END AS pa,
                         CASE WHEN nb > 0 THEN (b + db * pb) / (nb + db) ELSE pb END AS pb
                  FROM t{width} t JOIN p{width - 1} q ON {shorter}),"""


ORACLES["op10_url_filter"] = rf"""
WITH rules(rule, rhost, rpath, v) AS (VALUES ('com/', 'com', '/', 'allow'),
       ('example.com/en/', 'example.com', '/en/', 'block'), ('www.example.com/en/', 'www.example.com', '/en/', 'allow'),
       ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
     x AS (SELECT page_id, url AS u, coalesce(contains(url, '://'), false) AS known,
                  substr(url, strpos(url, '://') + 3) AS rest FROM pages),
     y AS (SELECT page_id, u, CASE WHEN known THEN translate(regexp_extract(rest, '^([^/?#]*)', 1),
                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
                  CASE WHEN known THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM x),
     j AS (SELECT page_id, u, host, path, max_by(rule, length(rule)) AS rule, max_by(v, length(rule)) AS ruled
           FROM y LEFT JOIN rules ON starts_with(path, rpath) AND (host = rhost OR ends_with(host, '.' || rhost))
           GROUP BY ALL),
     urls AS (SELECT u, count(*) FILTER (ruled = 'allow')::DOUBLE AS a, count(*) FILTER (ruled = 'block')::DOUBLE AS b
              FROM j WHERE u IS NOT NULL GROUP BY u),
     g AS (SELECT u, a, b, substr(t, i, 3) AS c, substr(t, i + 3, 1) AS s
           FROM (SELECT u, a, b, t, unnest(range(1, length(t) - 2)) AS i
                 FROM (SELECT *, repeat(chr(2), 3) || translate(lower(u), '123456789', '000000000') AS t FROM urls))),
     cnt AS (SELECT c, s, sum(a) AS a, sum(b) AS b FROM g GROUP BY ALL),
     t0 AS (SELECT s, sum(a) AS a, sum(b) AS b FROM cnt GROUP BY s),
     z AS (SELECT sum(a) AS na, sum(b) AS nb, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM t0),
     p0 AS (SELECT '' AS c, s, (a + da / 256) / (na + da) AS pa, (b + db / 256) / (nb + db) AS pb FROM t0, z),
     {"".join(_level(w) for w in (1, 2, 3)).strip()}
     sc AS (SELECT u, round(avg(ln(pa) - ln(pb)), 9) AS score FROM g JOIN p3 USING (c, s) GROUP BY u),
     st AS (SELECT floor(coalesce(score, 0) / 0.01)::BIGINT AS step, sum(a) AS a, sum(b) AS b
            FROM urls LEFT JOIN sc USING (u) WHERE a + b > 0 GROUP BY ALL),
     cal AS (SELECT step, round(coalesce(sum(b) OVER below, 0) / sum(b) OVER () - coalesce(sum(a) OVER below, 0) / sum(a) OVER (), 9) AS fit
             FROM st WINDOW below AS (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
     th AS (SELECT step * 0.01::DOUBLE AS cut FROM cal ORDER BY fit DESC, step LIMIT 1)
SELECT page_id, host, path, rule,
       coalesce(ruled, CASE WHEN coalesce(score, 0) >= (SELECT cut FROM th) THEN 'allow' ELSE 'block' END) AS verdict
FROM j LEFT JOIN sc USING (u)
"""
