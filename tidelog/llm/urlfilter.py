"""URL filter: rules first, then the ratio of two character language models.

URLs that a rule decides are the training texts: one smoothed variable-order
Markov model of the accepted ones, one of the rejected ones.  A character is
predicted from up to three before it by Witten-Bell smoothing,

    P_k(s | c) = (n(c s) + D(c) P_(k-1)(s | c')) / (N(c) + D(c)),

where N(c) counts the characters seen after context c, D(c) the different ones,
c' is c without its first character, and P_(-1) is uniform over 256.  A context
that a class has not seen leaves the shorter one's prediction.  The score of a
URL is the mean over its characters of the difference of the log-likelihoods,
and the threshold is calibrated on the rules' own verdicts.

All of it is DataFrame operations on distinct URLs.  The counts cover every
page; they grow with the corpus up to the number of different four-character
grams, and the table of their log ratios is broadcast only up to
``max_broadcast_rows`` rows, else joined by shuffle.

Defined results: a null URL, or one without ``://``, has empty host and path
and matches no rule; a URL without characters scores 0; without training URLs
of both classes all that no rule decides is allowed; repeated rows are judged
one by one; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.llm.common import materialize

CONTEXT = 3
MAX_BROADCAST_ROWS = 500_000
#: Width of the steps in which a threshold is looked for.
STEP = 0.01

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BEFORE = "\u0002"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains, below a path."""

    verdict: str
    host: str
    path: str

    @staticmethod
    def parse(text: str) -> Rule:
        verdict, _, place = text.partition(" ")
        host, slash, rest = place.partition("/")
        if verdict not in ("allow", "block"):
            raise ValueError(f"a rule allows or blocks: {text}")
        return Rule(verdict, host.lower(), slash + rest)

    @property
    def place(self) -> str:
        return self.host + self.path


def with_rule(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds host, path, and rule and its verdict (null if none fits) to a table with the column ``u``."""
    known = F.coalesce(F.locate("://", F.col("u")) > 0, F.lit(False))
    rest = F.expr("substring(u, locate('://', u) + 3)")
    host = F.when(known, F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)).otherwise("")
    path = F.when(known, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")
    out = urls.withColumn("host", host).withColumn("path", path)
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.place), r.place)):  # the longest is asked first
        fits = F.col("path").startswith(r.path) & (
            (F.col("host") == r.host) | F.col("host").endswith(f".{r.host}")
        )
        rule, verdict = F.when(fits, r.place).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return out.withColumn("rule", rule).withColumn("ruled", verdict)


def _grams(urls: DataFrame, *keep: str) -> DataFrame:
    """One row per character of each URL: its context ``c`` of three characters, and itself, ``s``."""
    text = F.translate(F.lower("u"), "123456789", "000000000")
    chars = F.array_remove(F.split(F.concat(F.lit(_BEFORE * CONTEXT), text), ""), "")
    grams = F.transform(
        F.sequence(F.lit(CONTEXT), F.size("x") - 1),
        lambda i: F.struct(
            F.concat(*[F.get("x", i - k) for k in range(CONTEXT, 0, -1)]).alias("c"), F.get("x", i).alias("s")
        ),
    )
    own = urls.where(F.length("u") > 0).select(*keep, chars.alias("x")).where(F.size("x") > CONTEXT)
    return own.select(*keep, F.explode(grams).alias("g")).select(*keep, "g.c", "g.s")


def log_ratios(counts: DataFrame) -> DataFrame:
    """c, s and log P(s | c) of the accepted minus that of the rejected, from columns c, s, allow and block."""
    level = counts.groupBy("s").agg(*[F.sum(v).cast("double").alias(v) for v in ("allow", "block")])
    total = level.agg(
        *[F.sum(v) for v in ("allow", "block")], *[F.sum((F.col(v) > 0).cast("double")) for v in ("allow", "block")]
    ).first()
    size = dict(zip(("allow", "block"), zip(total[:2], total[2:], strict=True), strict=True))
    p = level.select(
        "s", *[((F.col(v) + size[v][1] / 256) / (size[v][0] + size[v][1])).alias(f"p_{v}") for v in ("allow", "block")]
    ).withColumn("c", F.lit(""))
    for width in range(1, CONTEXT + 1):
        context = F.substring("c", -width, width)
        level = counts.groupBy(context.alias("c"), "s").agg(
            *[F.sum(v).cast("double").alias(v) for v in ("allow", "block")]
        )
        of = W.partitionBy("c")
        for v in ("allow", "block"):
            level = level.withColumn(f"n_{v}", F.sum(v).over(of)).withColumn(
                f"d_{v}", F.sum((F.col(v) > 0).cast("double")).over(of)
            )
        shorter = p.select(F.col("c").alias("short"), F.col("s").alias("s0"), "p_allow", "p_block")
        tail = F.substring("c", -(width - 1), width - 1) if width > 1 else F.lit("")
        level = level.withColumn("tail", tail)
        level = level.join(shorter, (level["tail"] == shorter["short"]) & (level["s"] == shorter["s0"]))
        p = level.select(
            "c",
            "s",
            *[
                F.when(
                    F.col(f"n_{v}") > 0,
                    (F.col(v) + F.col(f"d_{v}") * F.col(f"p_{v}")) / (F.col(f"n_{v}") + F.col(f"d_{v}")),
                )
                .otherwise(F.col(f"p_{v}"))
                .alias(f"p_{v}")
                for v in ("allow", "block")
            ],
        )
    return p.select("c", "s", (F.log("p_allow") - F.log("p_block")).alias("ratio"))


def judge(pages: DataFrame, rules: list[Rule], max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict, and score (null where there is no model) of every page."""
    own = pages.select(F.col("page_id"), F.col("url").cast("string").alias("u"))
    urls = with_rule(own.groupBy("u").agg(F.count("*").alias("n")).where("u is not null"), rules)
    sides = [F.when(F.col("ruled") == v, F.col("n")).otherwise(0).alias(v) for v in ("allow", "block")]
    urls = materialize(urls.select("u", "n", *sides), "urls")
    # few bytes become a row for each character: dealt out by number, lest they are read as one partition
    dealt = urls.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), "u")
    counts = materialize(
        _grams(dealt, "allow", "block").groupBy("c", "s").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")),
        "grams",
    )
    seen = counts.agg(F.sum("allow"), F.sum("block")).first()
    judged = with_rule(own, rules)
    if not seen[0] or not seen[1]:
        return judged.select(
            "page_id", "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict"),
            F.lit(None).cast("double").alias("score"),
        )
    model = materialize(log_ratios(counts), "ratios")
    if model.count() <= max_broadcast_rows:
        model = F.broadcast(model)
    scored = _grams(dealt, "u").join(model, ["c", "s"]).groupBy("u").agg(F.round(F.avg("ratio"), 9).alias("score"))
    scored = materialize(scored, "scores")
    ruled = urls.where("allow + block > 0").join(scored, "u", "left").select("allow", "block", F.coalesce("score", F.lit(0.0)).alias("score"))
    steps = ruled.groupBy(F.floor(F.col("score") / STEP).alias("step")).agg(
        F.sum("allow").alias("allow"), F.sum("block").alias("block")
    )
    # as many rows as there are steps between the extreme scores
    below = W.orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    right = F.coalesce(F.sum("block").over(below), F.lit(0)) / F.sum("block").over(W.partitionBy()) - F.coalesce(
        F.sum("allow").over(below), F.lit(0)
    ) / F.sum("allow").over(W.partitionBy())
    best = steps.select("step", F.round(right, 9).alias("right")).orderBy(F.desc("right"), "step").first()
    threshold = best["step"] * STEP
    own_score = F.coalesce("score", F.lit(0.0))
    return judged.join(scored, "u", "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("ruled", F.when(own_score >= threshold, "allow").otherwise("block")).alias("verdict"),
        own_score.alias("score"),
    )
