"""Queries over the operation log that the ``events`` table stands for, and over other keyed tables.

The log: event n is operation n + 1 on its user's key; an ``error`` deletes.
Where a query splits the log, it does so at a share of it, so that both parts grow with it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.api import Database
from tidelog.functions import keys
from tidelog.operators import feed, merge, overlay, picker, resolve, stats
from tidelog.schema import TableSchema, column, pad, violation
from tidelog.sources.export import exported_files
from tidelog.sources.mirror import Mirror
from tidelog.sources.replica import Replica
from tidelog.sources.sqlfeed import select_changes
from tidelog.sources.table import KeyedTable, Options
from tidelog.sources.workspace import scratch
from tidelog.streaming.tail import TailSink, label_stream, read_log

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

PK = ["pk"]
SCHEMA = TableSchema(
    "log", (column("pk", "long", nullable=False), column("event_type", "string"), column("value", "double")), ("pk",)
)

#: The log in DuckDB.
LOG = """ops AS (SELECT event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS op,
                user_id AS pk, event_type, value FROM events)"""
RANKED = """r AS (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY seq DESC) AS rn FROM ops)"""
FEED = """f AS (SELECT seq, pk AS k, op AS o, event_type AS e, value AS v, lag(op) OVER w AS po, lag(pk) OVER w AS pp,
                lag(event_type) OVER w AS pe, lag(value) OVER w AS pv
         FROM ops WINDOW w AS (PARTITION BY pk ORDER BY seq)),
  feed AS (SELECT seq, CASE WHEN o = 0 THEN 'DELETE' WHEN po = 1 THEN 'UPDATE' ELSE 'INSERT' END AS op,
                  CASE WHEN o = 1 THEN k WHEN po = 1 THEN pp END AS pk,
                  CASE WHEN o = 1 THEN e WHEN po = 1 THEN pe END AS event_type,
                  CASE WHEN o = 1 THEN v WHEN po = 1 THEN pv END AS value FROM f)"""


def at(percent: int) -> str:
    """In SQL: the operation up to which so much of the log lies."""
    return f"(SELECT (max(event_id) + 1) * {percent} // 100 FROM events)"


def upto(spark: SparkSession, sf_dir: str, percent: int) -> int:
    """The same number; from the statistics of the files."""
    return (table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] + 1) * percent // 100


def query(sql: str | None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the SQL it must equal."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log(spark: SparkSession, sf_dir: str, since: int | None = None, until: int | None = None) -> DataFrame:
    """The log, or its part ``(since, until]``; a bound on ``event_id + 1`` would not reach the scan."""
    events = table(spark, sf_dir, "events")
    if since is not None:
        events = events.where((F.col("event_id") >= since) & (F.col("event_id") < until))
    return events.select(
        (F.col("event_id") + 1).alias("seq"),
        F.when(F.col("event_type") == "error", 0).otherwise(1).alias("op"),
        F.col("user_id").alias("pk"),
        "event_type",
        "value",
    )


# current state, look-ups, ranges


@query(f"WITH {LOG}, {RANKED} SELECT seq, pk, event_type, value FROM r WHERE rn = 1 AND op = 1")
def current_state(spark, sf_dir):
    return resolve.current_state(log(spark, sf_dir), PK)


@query(
    f"WITH {LOG.replace('FROM events', f'FROM events WHERE event_id < {at(60)}')}, {RANKED} "
    "SELECT seq, pk, event_type, value FROM r WHERE rn = 1 AND op = 1"
)
def current_state_as_of(spark, sf_dir):
    return resolve.current_state(log(spark, sf_dir), PK, as_of=upto(spark, sf_dir, 60))


@query(f"WITH {LOG}, {RANKED} SELECT seq, pk, event_type, value FROM r WHERE rn = 1 AND op = 1 AND pk = 7")
def point_lookup(spark, sf_dir):
    return resolve.point_lookup(log(spark, sf_dir), PK, (7,))


@query(
    f"WITH {LOG.replace('FROM events', f'FROM events WHERE event_id < {at(70)}')}, {RANKED} "
    "SELECT seq, pk, event_type, value FROM r WHERE rn = 1 AND op = 1 AND pk = 9"
)
def point_lookup_as_of(spark, sf_dir):
    return resolve.point_lookup(log(spark, sf_dir), PK, (9,), as_of=upto(spark, sf_dir, 70))


@query(
    f"WITH {LOG}, {RANKED} SELECT seq, pk, event_type, value FROM r WHERE rn = 1 AND op = 1 AND pk >= 3 AND pk < 90"
)
def range_scan(spark, sf_dir):
    return resolve.range_scan(log(spark, sf_dir), PK, (3,), (90,), ordered=True)


@query(
    "SELECT conv_id, turn, role, length(text) AS n_chars FROM conversations "
    "WHERE (conv_id > 3 OR (conv_id = 3 AND turn >= 1)) AND (conv_id < 50 OR (conv_id = 50 AND turn < 2))"
)
def range_scan_composite_pk(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("seq", F.lit(1)).withColumn("op", F.lit(1))
    found = resolve.range_scan(rows, ["conv_id", "turn"], (3, 1), (50, 2))
    return found.select("conv_id", "turn", "role", F.length("text").cast("long").alias("n_chars"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 1100")
def range_scan_orders(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("seq", F.lit(1)).withColumn("op", F.lit(1))
    found = resolve.range_scan(rows, ["o_orderkey"], (100,), (1100,))
    return found.select("o_orderkey", "o_custkey", "o_orderstatus")


@query(f"WITH {LOG} SELECT op, count(*) AS n, max(seq) AS newest FROM ops WHERE seq <= {at(50)} GROUP BY op")
def visible_operations(spark, sf_dir):
    seen = resolve.visible(log(spark, sf_dir), upto(spark, sf_dir, 50))
    return seen.groupBy("op").agg(F.count("*").alias("n"), F.max("seq").alias("newest"))


@query(f"WITH {LOG}, {RANKED} SELECT pk, event_type, value FROM r WHERE rn = 1 AND op = 1")
def dedup_external_contract(spark, sf_dir):
    sql = resolve.dedup_sql("{versions}", PK, ["pk", "event_type", "value"])
    return spark.sql(sql, versions=log(spark, sf_dir))


@query(f"WITH {LOG}, {RANKED} SELECT seq, op, pk, event_type, value FROM r WHERE rn = 1")
def newest_per_key(spark, sf_dir):
    return resolve.newest(log(spark, sf_dir), PK)


@query(f"WITH {LOG} SELECT pk, seq, op FROM ops ORDER BY pk, seq DESC")
def versions_in_order(spark, sf_dir):
    return resolve.in_version_order(log(spark, sf_dir), PK).select("pk", "seq", "op")


# the change feed


@query(f"WITH {LOG}, {FEED} SELECT seq, op, pk, event_type, value FROM feed")
def feed_all(spark, sf_dir):
    return feed.change_feed(log(spark, sf_dir), PK, until=upto(spark, sf_dir, 100))


@query(f"WITH {LOG}, {FEED} SELECT seq, op, pk, event_type, value FROM feed WHERE seq > {at(90)}")
def feed_since(spark, sf_dir):
    return feed.change_feed(log(spark, sf_dir), PK, since=upto(spark, sf_dir, 90), until=upto(spark, sf_dir, 100))


@query(f"WITH {LOG}, {FEED} SELECT seq, op, pk, event_type, value FROM feed WHERE seq > {at(50)} AND seq <= {at(90)}")
def feed_window(spark, sf_dir):
    return feed.change_feed(log(spark, sf_dir), PK, since=upto(spark, sf_dir, 50), until=upto(spark, sf_dir, 90))


@query(f"WITH {LOG}, {FEED} SELECT seq, op, pk, event_type, value FROM feed")
def feed_split_keys(spark, sf_dir):
    return feed.change_feed(log(spark, sf_dir), PK, split_every=1_000)


@query(
    f"WITH {LOG}, {FEED} SELECT seq, CASE op WHEN 'UPDATE' THEN 'INSERT' ELSE op END AS op, pk, event_type, value FROM feed"
)
def feed_skip_discrimination(spark, sf_dir):
    return feed.change_feed(log(spark, sf_dir), PK, discriminate=False)


@query(
    f"WITH {LOG} SELECT seq, CASE WHEN op = 0 THEN 'DELETE' ELSE 'INSERT' END AS op, CASE WHEN op = 1 THEN pk END AS pk, "
    f"CASE WHEN op = 1 THEN event_type END AS event_type, CASE WHEN op = 1 THEN value END AS value FROM ops WHERE seq > {at(10)}"
)
def feed_labels_only(spark, sf_dir):
    return feed.labels_only(log(spark, sf_dir), since=upto(spark, sf_dir, 10))


@query(f"WITH {LOG}, {FEED} SELECT seq, pk, event_type, value FROM feed WHERE op = 'DELETE'")
def feed_deletes(spark, sf_dir):
    changes = feed.change_feed(log(spark, sf_dir), PK)
    return spark.sql("SELECT seq, pk, event_type, value FROM {changes} WHERE op = 'DELETE'", changes=changes)


@query(f"WITH {LOG}, {FEED} SELECT op, count(*) AS n FROM feed GROUP BY op")
def feed_counts_by_op(spark, sf_dir):
    changes = feed.change_feed(log(spark, sf_dir), PK)
    return changes.groupBy("op").agg(F.count("*").alias("n"))


@query(f"WITH {LOG}, {FEED} SELECT seq, op FROM feed WHERE seq > {at(25)} ORDER BY seq LIMIT 40")
def cursor_page(spark, sf_dir):
    changes = feed.change_feed(log(spark, sf_dir), PK, since=upto(spark, sf_dir, 25))
    return changes.select("seq", "op").orderBy("seq").limit(40)


@query(
    f"""WITH {LOG}, {FEED} SELECT seq, op, pk, (row_number() OVER (ORDER BY seq) - 1) // 300 AS page, seq AS since
    FROM feed WHERE seq > {at(95)}"""
)
def cursor_pages(spark, sf_dir):
    """All pages up to the head.  A cursor hands its rows to the caller, page by page, who writes them out in parts."""
    ops, head, to = log(spark, sf_dir), upto(spark, sf_dir, 100), scratch(spark, "pages")
    cursor = feed.Cursor(lambda since: feed.change_feed(ops, PK, since, head), upto(spark, sf_dir, 95))
    schema, found, page = "seq long, op string, pk long, page long, since long", [], 0

    def write_out() -> None:
        spark.createDataFrame(found, schema).write.mode("append").parquet(to)
        found.clear()

    while rows := cursor.next_batch(300):
        found += [(r.seq, r.op, r.pk, page, r.seq) for r in rows]
        page += cursor.since_seq == rows[-1].seq
        if len(found) >= 100_000:
            write_out()
    write_out()
    return spark.read.schema(schema).parquet(to)


@query(f"WITH {LOG} SELECT seq, op, pk FROM ops WHERE seq > {at(80)}")
def unmerged_operations(spark, sf_dir):
    return log(spark, sf_dir).where(feed.in_window(upto(spark, sf_dir, 80), None)).select("seq", "op", "pk")


@query(
    f"""WITH {LOG}, {FEED} SELECT seq, op, pk, event_type, value,
    CASE WHEN pk IS NOT NULL THEN upper(printf('%016x', (pk::HUGEINT + 9223372036854775808)::UBIGINT))
         ELSE upper(printf('%016x', (k::HUGEINT + 9223372036854775808)::UBIGINT)) END AS key
    FROM feed JOIN (SELECT seq, pk AS k FROM ops) USING (seq)"""
)
def feed_schema(spark, sf_dir):
    """Key bytes of every change, of deletions that removed nothing too."""
    ops = log(spark, sf_dir)
    changes = feed.change_feed(ops, PK, key_bytes=keys.pk_bytes(SCHEMA))
    assert changes.columns == ["seq", "op", "pk_bytes", "pk", "event_type", "value"]
    return changes.withColumn("key", F.hex("pk_bytes")).drop("pk_bytes")


@query(
    f"""WITH {LOG}, {FEED} SELECT c_mktsegment, op, count(*) AS n, round(sum(value), 2) AS total
    FROM feed JOIN customer ON pk = c_custkey GROUP BY ALL"""
)
def feed_with_dimension(spark, sf_dir):
    changes = feed.change_feed(log(spark, sf_dir), PK)
    joined = changes.join(table(spark, sf_dir, "customer"), F.col("pk") == F.col("c_custkey"))
    return joined.groupBy("c_mktsegment", "op").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")
    )


@query(
    f"""WITH {LOG}, {FEED} SELECT op, event_type, count(*) AS n, grouping(op, event_type) AS level
    FROM feed GROUP BY ROLLUP (op, event_type)"""
)
def feed_rollup(spark, sf_dir):
    changes = feed.change_feed(log(spark, sf_dir), PK)
    return changes.rollup("op", "event_type").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@query(
    f"""WITH {LOG}, {FEED} SELECT pk, count(*) AS n FROM feed WHERE op = 'UPDATE' GROUP BY pk
    ORDER BY n DESC, pk LIMIT 10"""
)
def busiest_keys(spark, sf_dir):
    changes = feed.change_feed(log(spark, sf_dir), PK).where("op = 'UPDATE'")
    return changes.groupBy("pk").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pk").limit(10)


# merging


@query(f"WITH {LOG}, {RANKED} SELECT seq, op, pk, event_type, value FROM r WHERE rn = 1")
def compact_keep_latest(spark, sf_dir):
    return merge.compact(log(spark, sf_dir), PK)


@query(f"WITH {LOG}, {RANKED} SELECT seq, op, pk, event_type, value FROM r WHERE rn = 1 OR seq >= {at(70)}")
def compact_with_snapshot_watermark(spark, sf_dir):
    return merge.compact(log(spark, sf_dir), PK, oldest_snapshot=upto(spark, sf_dir, 70))


@query(
    f"WITH {LOG}, {RANKED} SELECT seq, op, pk, event_type, value FROM r "
    f"WHERE (rn = 1 OR seq >= {at(95)}) AND NOT (rn = 1 AND op = 0 AND seq < {at(95)})"
)
def compact_bottom_level(spark, sf_dir):
    return merge.compact(log(spark, sf_dir), PK, oldest_snapshot=upto(spark, sf_dir, 95), drop_deletions=True)


_BASE = f"""WITH {LOG}, base AS (SELECT seq, pk, event_type, value FROM (SELECT *, row_number() OVER
    (PARTITION BY pk ORDER BY seq DESC) AS rn FROM ops WHERE seq <= {at(60)}) WHERE rn = 1 AND op = 1),
  tail AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY seq DESC) AS rn FROM ops
    WHERE seq > {at(60)}) WHERE rn = 1)"""


def _base_and_tail(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ops, cut = log(spark, sf_dir), upto(spark, sf_dir, 60)
    return resolve.current_state(ops, PK, as_of=cut), ops.where(F.col("seq") > cut)


@query(
    _BASE + """ SELECT seq, pk, event_type, value FROM base WHERE pk NOT IN (SELECT pk FROM tail)
    UNION ALL SELECT seq, pk, event_type, value FROM tail WHERE op = 1"""
)
def tail_over_base(spark, sf_dir):
    base, tail = _base_and_tail(spark, sf_dir)
    return overlay.overlay(base, tail, PK)


@query(_BASE + " SELECT pk FROM base WHERE pk IN (SELECT pk FROM tail WHERE op = 0)")
def tail_delete_hides_base(spark, sf_dir):
    base, tail = _base_and_tail(spark, sf_dir)
    held = resolve.newest(tail, PK).where("op = 0").select("pk")
    return base.join(held, "pk", "left_semi").select("pk")


@query(_BASE + " SELECT seq, op, pk, event_type, value FROM tail")
def tail_apply(spark, sf_dir):
    ops, (a, b, c) = log(spark, sf_dir), (upto(spark, sf_dir, k) for k in (60, 70, 80))
    # the second part comes twice, and with older operations that must be dropped
    return overlay.apply_tail(ops.where(feed.in_window(a, c)), ops.where(feed.in_window(b, None)), PK)


_ZEROS = f"""WITH {LOG}, z AS (SELECT seq, op, CASE pk % 5 WHEN 1 THEN '-0.0'::DOUBLE WHEN 2 THEN 0.0::DOUBLE ELSE pk::DOUBLE END AS k, value FROM ops),
  base AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k::VARCHAR ORDER BY seq DESC) AS rn FROM z WHERE seq <= {at(60)}) WHERE rn = 1 AND op = 1),
  tail AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k::VARCHAR ORDER BY seq DESC) AS rn FROM z WHERE seq > {at(60)}) WHERE rn = 1)"""


def _zeros(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with a fifth of its keys on -0.0 and a fifth on 0.0."""
    rest = F.col("pk") % 5
    k = F.when(rest == 1, F.lit(-0.0)).when(rest == 2, F.lit(0.0)).otherwise(F.col("pk").cast("double"))
    return log(spark, sf_dir).select("seq", "op", k.alias("k"), "value")


@query(
    _ZEROS + """ SELECT seq, k::VARCHAR AS key, value FROM base WHERE k::VARCHAR NOT IN (SELECT k::VARCHAR FROM tail)
    UNION ALL SELECT seq, k::VARCHAR, value FROM tail WHERE op = 1"""
)
def overlay_float_keys(spark, sf_dir):
    ops, cut = _zeros(spark, sf_dir), upto(spark, sf_dir, 60)
    found = overlay.overlay(resolve.current_state(ops, ["k"], as_of=cut), ops.where(F.col("seq") > cut), ["k"])
    return found.select("seq", F.col("k").cast("string").alias("key"), "value")


@query(_ZEROS + """ SELECT k::VARCHAR AS key, value FROM (SELECT *, row_number() OVER (PARTITION BY k::VARCHAR ORDER BY seq DESC) AS n FROM z) WHERE n = 1 AND op = 1""")
def dedup_external_contract_floats(spark, sf_dir):
    sql = resolve.dedup_sql("{versions}", ["k"], ["CAST(k AS STRING) AS key", "value"], floats=["k"])
    return spark.sql(sql, versions=_zeros(spark, sf_dir))


@query(
    _ZEROS + f""" SELECT seq FROM z WHERE seq <= {at(60)} AND k::VARCHAR IN (SELECT k::VARCHAR FROM z WHERE seq > {at(60)})"""
)
def dv_positions_float_keys(spark, sf_dir):
    rows, cut = _zeros(spark, sf_dir), upto(spark, sf_dir, 60)
    rows = rows.withColumn("file_path", F.lit("f")).withColumn("row_index", F.col("seq"))
    return merge.superseded(rows.where(F.col("seq") <= cut), ["k"], rows.where(F.col("seq") > cut)).select(F.col("row_index").alias("seq"))


# positions: operation n is row (n - 1) % 250 of file (n - 1) / 250

_FILES = f"""{LOG}, rows_ AS (SELECT *, 'file-' || ((seq - 1) // 250) AS file_path, (seq - 1) % 250 AS row_index FROM ops)"""


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("seq") - 1
    return log(spark, sf_dir).select(
        "*", F.concat(F.lit("file-"), F.floor(at / 250).cast("string")).alias("file_path"), (at % 250).alias("row_index")
    )


@query(
    f"""WITH {_FILES} SELECT file_path, row_index FROM rows_ WHERE seq <= {at(75)}
    AND pk IN (SELECT pk FROM ops WHERE seq > {at(75)}) AND NOT (seq <= {at(10)})"""
)
def dv_positions(spark, sf_dir):
    rows, cut, seq = _rows(spark, sf_dir), upto(spark, sf_dir, 75), F.col("seq")
    marked = rows.where(seq <= upto(spark, sf_dir, 10)).select("file_path", "row_index")
    return merge.superseded(rows.where(seq <= cut), PK, rows.where(seq > cut), marked)


@query(
    f"""WITH {_FILES} SELECT seq, pk, op FROM rows_ WHERE NOT (seq <= {at(75)} AND pk IN (SELECT pk FROM ops WHERE seq > {at(75)}))"""
)
def dv_apply(spark, sf_dir):
    rows, cut, seq = _rows(spark, sf_dir), upto(spark, sf_dir, 75), F.col("seq")
    marked = merge.superseded(rows.where(seq <= cut), PK, rows.where(seq > cut))
    return merge.without_positions(rows, marked).select("seq", "pk", "op")


@query(f"WITH {_FILES} SELECT file_path, row_index FROM rows_")
def dv_union(spark, sf_dir):
    rows, seq = _rows(spark, sf_dir), F.col("seq")
    return merge.union_positions(rows.where(seq <= upto(spark, sf_dir, 60)), rows.where(seq > upto(spark, sf_dir, 30)))


@query(f"WITH {_FILES}, {RANKED} SELECT file_path, row_index FROM rows_ WHERE seq IN (SELECT seq FROM r WHERE rn > 1)")
def dv_replaced(spark, sf_dir):
    return merge.replaced(_rows(spark, sf_dir), PK)


@query(
    f"""WITH {_FILES}, n AS (SELECT *, row_number() OVER (PARTITION BY file_path, pk ORDER BY seq DESC) AS n FROM rows_
    WHERE pk >= 3 AND pk < 90 AND seq % 7 <> 0) SELECT file_path, row_index, seq, op, pk, event_type, value FROM n WHERE n = 1"""
)
def file_scan(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return merge.file_scan(rows, PK, (3,), (90,), rows.where("seq % 7 = 0"))


@query(f"WITH {_FILES} SELECT pk, file_path, row_index FROM rows_ WHERE pk BETWEEN 3 AND 8")
def key_positions(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return merge.keys_in_range(rows, PK, (3,), (8,))


@query(
    f"""WITH {_FILES}, first AS (SELECT file_path, coalesce(sum(n) OVER (ORDER BY low ROWS BETWEEN UNBOUNDED PRECEDING
    AND 1 PRECEDING), 0)::BIGINT AS first_row_id FROM (SELECT file_path, count(*) AS n, min(seq) AS low FROM rows_ GROUP BY 1))
    SELECT seq, first_row_id + row_index AS row_id FROM rows_ JOIN first USING (file_path)"""
)
def row_lineage(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    files = rows.groupBy("file_path").agg(F.count("*").alias("n"), F.min("seq").alias("low"))
    before = F.sum("n").over(W.orderBy("low").rowsBetween(W.unboundedPreceding, -1))
    first = files.select("file_path", F.coalesce(before, F.lit(0)).alias("first_row_id"))
    return merge.lineage(rows, first).select("seq", "row_id")


# statistics and policy


@query(
    f"""WITH {_FILES} SELECT file_path, count(*) AS n_rows, count(pk) AS pk_values, count(*) - count(pk) AS pk_nulls,
    min(pk) AS pk_min, max(pk) AS pk_max, count(value) AS value_values, count(*) - count(value) AS value_nulls,
    min(value) AS value_min, max(value) AS value_max FROM rows_ GROUP BY file_path"""
)
def file_stats(spark, sf_dir):
    return stats.column_stats(_rows(spark, sf_dir), ["pk", "value"])


@query(
    f"""WITH {LOG}, base AS (SELECT op FROM (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY seq DESC) AS rn FROM ops
    WHERE seq <= {at(60)}) WHERE rn = 1 AND op = 1)
    SELECT 0 AS level, count(*)::BIGINT AS rows, sum(op)::BIGINT AS live_rows FROM ops
    UNION ALL SELECT 1, count(*)::BIGINT, count(*)::BIGINT FROM base"""
)
def level_statistics(spark, sf_dir):
    return stored_table(spark, sf_dir).level_table().select("level", "rows", "live_rows")


@query(
    f"""WITH {_FILES}, f AS (SELECT file_path, count(*) * 100 AS bytes, min(seq) AS low FROM rows_ GROUP BY 1),
    s AS (SELECT *, sum(bytes) OVER w AS total, row_number() OVER w AS n FROM f WINDOW w AS (ORDER BY low))
    SELECT file_path, bytes::BIGINT AS bytes FROM s WHERE total <= {at(60)} * 100 OR n = 1"""
)
def compaction_pick_prefix(spark, sf_dir):
    """The files, 100 bytes a row, that hold the first part of the log."""
    files = _rows(spark, sf_dir).groupBy("file_path").agg((F.count("*") * 100).alias("bytes"), F.min("seq").alias("low"))
    return picker.take_prefix(files, "low", 100 * upto(spark, sf_dir, 60)).select("file_path", "bytes")


# schema and keys


@query(
    """SELECT doc_id, n_chars, CAST(NULL AS BIGINT) AS tokens, 'none' AS origin FROM documents WHERE doc_id < 100
    UNION ALL SELECT doc_id, n_chars, NULL, source FROM documents WHERE doc_id >= 100"""
)
def schema_default_fill(spark, sf_dir):
    grown = TableSchema(
        "docs",
        (
            column("doc_id", "long", nullable=False),
            column("n_chars", "long"),
            column("tokens", "long"),
            column("origin", "string", initial_default="none"),
        ),
        ("doc_id",),
    )
    docs = table(spark, sf_dir, "documents")
    old = pad(docs.where("doc_id < 100").select("doc_id", "n_chars"), grown, initial=True)
    new = pad(docs.where("doc_id >= 100").select("doc_id", "n_chars", F.col("source").alias("origin")), grown)
    return old.unionByName(new)


@query(
    """SELECT c_custkey, CASE WHEN c_nationkey % 5 = 0 THEN 'tag may not be null' WHEN c_nationkey % 5 = 1
    THEN 'tag takes 2 bytes' END AS why FROM customer"""
)
def row_violations(spark, sf_dir):
    schema = TableSchema(
        "checked", (column("c_custkey", "long", nullable=False), column("tag", "fixed[2]", nullable=False)), ("c_custkey",)
    )
    rest = F.col("c_nationkey") % 5
    tag = F.when(rest == 1, "abc").when(rest > 1, "ab").cast("binary")
    return table(spark, sf_dir, "customer").withColumn("tag", tag).select("c_custkey", violation(schema).alias("why"))


@query("SELECT event_id, upper(printf('%016x', (user_id::HUGEINT + 9223372036854775808)::UBIGINT)) AS key FROM events")
def pk_bytes_long(spark, sf_dir):
    schema = TableSchema("t", (column("user_id", "long", nullable=False),), ("user_id",))
    return table(spark, sf_dir, "events").select("event_id", F.hex(keys.pk_bytes(schema)).alias("key"))


@query(
    """SELECT conv_id, turn, upper(printf('%016x', (turn::HUGEINT - 2 + 9223372036854775808)::UBIGINT)) ||
    replace(hex(encode(role)), '@', '') || '00FF' || upper(hex(encode(role))) || '0000' AS key FROM conversations"""
)
def pk_bytes_composite(spark, sf_dir):
    schema = TableSchema(
        "t", (column("n", "long", nullable=False), column("name", "binary", nullable=False)), ("n", "name")
    )
    role = F.encode("role", "UTF-8")
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", (F.col("turn") - 2).alias("n"), F.concat(role, F.unhex(F.lit("00")), role).alias("name")
    )
    return rows.select("conv_id", "turn", F.hex(keys.pk_bytes(schema)).alias("key"))


@query(
    """WITH v AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN -value ELSE value END AS value FROM events WHERE value IS NOT NULL),
    b AS (SELECT *, value::BIT::BIGINT::HUGEINT AS b FROM v)
    SELECT event_id, value, upper(printf('%016x', (CASE WHEN b < 0 THEN -b - 1 ELSE b + 9223372036854775808 END)::UBIGINT)) AS key FROM b"""
)
def pk_bytes_double(spark, sf_dir):
    schema = TableSchema("t", (column("value", "double", nullable=False),), ("value",))
    signed = F.when(F.col("event_id") % 2 == 0, -F.col("value")).otherwise(F.col("value")).alias("value")
    rows = table(spark, sf_dir, "events").where("value IS NOT NULL").select("event_id", signed)
    return rows.select("event_id", "value", F.hex(keys.pk_bytes(schema)).alias("key"))


@query(f"WITH {LOG} SELECT seq, op, seq AS decoded FROM ops")
def version_key_seq(spark, sf_dir):
    version = keys.version_key(keys.pk_bytes(SCHEMA), F.col("seq"), F.col("op"))
    return log(spark, sf_dir).select("seq", "op", keys.seq_of(version).alias("decoded"))


# tables on storage


def stored_table(spark: SparkSession, sf_dir: str) -> KeyedTable:
    """The log in a stored table: two batches with a merge between them."""
    ops, cut = log(spark, sf_dir), upto(spark, sf_dir, 60)
    stored = KeyedTable.open(spark, scratch(spark, "table"), SCHEMA, Options(compact_after=0))
    stored.write(ops.where(F.col("seq") <= cut), order_by=["seq"], op="op")
    stored.compact()
    stored.write(ops.where(F.col("seq") > cut), order_by=["seq"], op="op")
    return stored


def batches(spark: SparkSession, sf_dir: str, n: int) -> list[DataFrame]:
    """The log in ``n`` parts of about equal size."""
    head = upto(spark, sf_dir, 100)
    ends = [head * (100 * k // n) // 100 for k in range(n + 1)]
    return [log(spark, sf_dir, a, b) for a, b in zip(ends[:-1], ends[1:], strict=True)]


@query(f"WITH {LOG}, {RANKED} SELECT pk, event_type, value FROM r WHERE rn = 1 AND op = 1")
def table_scan(spark, sf_dir):
    return stored_table(spark, sf_dir).scan()


@query(f"WITH {LOG}, {FEED} SELECT seq, op, pk, event_type, value FROM feed WHERE seq > {at(55)}")
def table_changes(spark, sf_dir):
    return stored_table(spark, sf_dir).changes(since=upto(spark, sf_dir, 55)).drop("pk_bytes")


@query(f"WITH {LOG}, {FEED} SELECT seq, op, pk FROM feed WHERE seq >= {at(58)} AND op <> 'INSERT' AND event_type <> 'x and seq > 0'")
def table_changes_sql(spark, sf_dir):
    where = f"seq >= {upto(spark, sf_dir, 58)} AND op <> 'INSERT' AND event_type <> 'x and seq > 0'"
    return select_changes(stored_table(spark, sf_dir), "seq, op, pk", where)


@query(f"WITH {LOG}, {RANKED} SELECT pk, event_type, value FROM r WHERE rn = 1 AND op = 1")
def replica_view(spark, sf_dir):
    first, second = batches(spark, sf_dir, 2)
    stored = KeyedTable.open(spark, scratch(spark, "replica"), SCHEMA, Options(compact_after=0))
    stored.write(first, order_by=["seq"], op="op")
    replica = Replica(spark, stored.catalog_path())
    stored.write(second, order_by=["seq"], op="op")
    replica.advance()
    return replica.view()


@query(f"WITH {LOG}, {RANKED} SELECT pk, event_type, value, 'recovered' AS how FROM r WHERE rn = 1 AND op = 1")
def replica_recovered(spark, sf_dir):
    """A replica whose log no longer reaches back builds a new base."""
    stored = KeyedTable.open(spark, scratch(spark, "replica"), SCHEMA, Options(compact_after=0))
    first, second, third = batches(spark, sf_dir, 3)
    stored.write(first, order_by=["seq"], op="op")
    replica = Replica(spark, stored.catalog_path())
    for part in (second, third):
        stored.write(part, order_by=["seq"], op="op")
    stored.expire(upto(spark, sf_dir, 66))
    how = replica.advance_or_recover()
    return replica.view().withColumn("how", F.lit(how))


@query(f"WITH {LOG}, {RANKED} SELECT pk, event_type, value FROM r WHERE rn = 1 AND op = 1")
def replica_rebased(spark, sf_dir):
    stored = KeyedTable.open(spark, scratch(spark, "replica"), SCHEMA, Options(compact_after=0))
    first, second, third = batches(spark, sf_dir, 3)
    stored.write(first, order_by=["seq"], op="op")
    replica = Replica(spark, stored.catalog_path())
    stored.write(second, order_by=["seq"], op="op")
    replica.advance()
    stored.compact()
    replica.rebase()
    stored.write(third, order_by=["seq"], op="op")
    replica.rebase_hotswap()
    return replica.view()


@query(f"WITH {LOG}, {RANKED} SELECT pk, event_type, value FROM r WHERE rn = 1 AND op = 1")
def exported_snapshot(spark, sf_dir):
    """Read as any reader of the format does: by the manifests."""
    to = scratch(spark, "export")
    stored_table(spark, sf_dir).export(to)
    return spark.read.schema(SCHEMA.struct()).parquet(*[f["file_path"] for f in exported_files(spark, to)])


@query(
    f"""WITH {LOG}, {RANKED} SELECT count(*) AS n_rows, count(*) FILTER (value IS NULL) AS value_nulls, min(pk) AS least, max(pk) AS most
    FROM r WHERE rn = 1 AND op = 1"""
)
def exported_statistics(spark, sf_dir):
    """Counts and bounds in the export's manifests, over all its files."""
    to = scratch(spark, "export")
    stored_table(spark, sf_dir).export(to)
    files = exported_files(spark, to)
    of = lambda f, what, c: next(p["value"] for p in f[what] if p["key"] == SCHEMA[c].field_id)
    number = lambda raw: int.from_bytes(raw, "little", signed=True)
    row = (
        sum(f["record_count"] for f in files), sum(of(f, "null_value_counts", "value") for f in files),
        min(number(of(f, "lower_bounds", "pk")) for f in files), max(number(of(f, "upper_bounds", "pk")) for f in files),
    )
    return spark.createDataFrame([row], "n_rows long, value_nulls long, least long, most long")


@query("SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS seq, o_orderkey, o_custkey FROM orders")
def table_batch_numbers(spark, sf_dir):
    schema = TableSchema("orders", (column("o_orderkey", "long", nullable=False), column("o_custkey", "long")), ("o_orderkey",))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    stored = KeyedTable.open(spark, scratch(spark, "orders"), schema, Options(compact_after=0))
    stored.write(orders, order_by=["o_orderdate", "o_orderkey"])
    return stored.operations().select("seq", "o_orderkey", "o_custkey")


@query(
    f"""WITH {LOG}, {RANKED} SELECT pk, event_type, value, CASE WHEN seq <= {at(60)} THEN 'old' ELSE 'new' END AS origin
    FROM r WHERE rn = 1 AND op = 1"""
)
def table_evolved_scan(spark, sf_dir):
    ops, cut = log(spark, sf_dir), upto(spark, sf_dir, 60)
    stored = KeyedTable.open(spark, scratch(spark, "evolved"), SCHEMA, Options(compact_after=0))
    stored.write(ops.where(F.col("seq") <= cut), order_by=["seq"], op="op")
    stored.add_column(column("origin", "string", initial_default="old"))
    stored.write(ops.where(F.col("seq") > cut).withColumn("origin", F.lit("new")), order_by=["seq"], op="op")
    stored.compact()
    return stored.scan()


@query(f"WITH {LOG}, {FEED} SELECT seq, op, pk, event_type, value FROM feed WHERE seq > {at(62)}")
def table_changes_after_expiry(spark, sf_dir):
    stored = stored_table(spark, sf_dir)
    stored.expire(upto(spark, sf_dir, 60))
    return stored.changes(since=upto(spark, sf_dir, 62)).drop("pk_bytes")


#: The state where the rows of every third key in the first part were marked as deleted.
_MARKED = f"""WITH {LOG}, m AS (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY seq DESC) AS n FROM ops
    WHERE NOT (seq <= {at(60)} AND pk % 3 = 0)) SELECT pk, event_type, value FROM m WHERE n = 1 AND op = 1"""


def marked_table(spark: SparkSession, sf_dir: str, merged: bool) -> KeyedTable:
    """The log in a table; the rows of every third key in its first part, merged or not, are marked."""
    ops, cut = log(spark, sf_dir), upto(spark, sf_dir, 60)
    stored = KeyedTable.open(spark, scratch(spark, "marked"), SCHEMA, Options(compact_after=0))
    stored.write(ops.where(F.col("seq") <= cut), order_by=["seq"], op="op")
    if merged:
        stored.compact()
    files = stored.snapshot().base if merged else stored.snapshot().log
    rows = spark.read.parquet(*[f"{stored.catalog_path()}/{f.path}" for f in files])
    stored.mark_deleted(merge.with_positions(rows).where("pk % 3 = 0"))
    stored.write(ops.where(F.col("seq") > cut), order_by=["seq"], op="op")
    return stored


@query(_MARKED)
def table_expired_with_marks(spark, sf_dir):
    """Rows that were marked do not come back when their files go."""
    stored = marked_table(spark, sf_dir, merged=False)
    stored.expire(upto(spark, sf_dir, 60))
    return stored.scan()


@query(f"WITH {LOG}, {FEED} SELECT seq, op, pk, event_type, value FROM feed WHERE seq > {at(60)}")
def table_changes_with_marks(spark, sf_dir):
    """The feed knows what was written, whatever is marked."""
    stored = marked_table(spark, sf_dir, merged=False)
    stored.expire(upto(spark, sf_dir, 60))
    stored.compact()
    return stored.changes(since=upto(spark, sf_dir, 60)).drop("pk_bytes")


@query(_MARKED)
def mirror_with_marks(spark, sf_dir):
    to = scratch(spark, "mirror")
    Mirror(marked_table(spark, sf_dir, merged=True), to).run()
    return KeyedTable.open_read_only(spark, to).scan()


def levelled_table(spark: SparkSession, sf_dir: str, flush: bool = False) -> KeyedTable:
    """The log in eight batches, with the merges that small levels ask for after each."""
    size = max(20_000, 2 * upto(spark, sf_dir, 100))
    how = Options(compact_after=0, l0_trigger=2, level_bytes=(size, 2 * size, 1 << 40), max_merge_bytes=size // 2, target_file_bytes=size // 4)
    stored = KeyedTable.open(spark, scratch(spark, "levels"), SCHEMA, how)
    for part in batches(spark, sf_dir, 8):
        stored.write(part, order_by=["seq"], op="op")
        stored.merge()
        if flush:
            stored.flush()
    return stored


@query(f"WITH {LOG}, {RANKED} SELECT pk, event_type, value FROM r WHERE rn = 1 AND op = 1")
def table_levels(spark, sf_dir):
    return levelled_table(spark, sf_dir).scan()


@query(f"WITH {LOG}, {RANKED} SELECT pk, event_type, value FROM r WHERE rn = 1 AND op = 1")
def table_levels_flushed(spark, sf_dir):
    """All rows that were replaced are marked, so no row is ranked."""
    return levelled_table(spark, sf_dir, flush=True).scan()


@query(f"WITH {LOG}, {FEED} SELECT seq, op, pk, event_type, value FROM feed WHERE seq > {at(87)}")
def table_levels_changes(spark, sf_dir):
    return levelled_table(spark, sf_dir).changes(since=upto(spark, sf_dir, 87)).drop("pk_bytes")


@query(f"WITH {LOG}, {RANKED} SELECT seq FROM r WHERE rn > 1")
def flush_marks(spark, sf_dir):
    """What four batches' flushes have marked: every row but the newest of its key, once."""
    stored = KeyedTable.open(spark, scratch(spark, "flushed"), SCHEMA, Options(compact_after=0, mark_superseded=True))
    for part in batches(spark, sf_dir, 4):
        stored.write(part, order_by=["seq"], op="op")
    rows = merge.with_positions(spark.read.parquet(*[f"{stored.catalog_path()}/{f.path}" for f in stored.snapshot().log]))
    marks = stored.marked_positions()
    same = (F.substring_index(rows["file_path"], "/", -3) == marks["file_path"]) & (rows["row_index"] == marks["row_index"])
    return rows.join(marks, same).select("seq")


@query(f"WITH {LOG}, {RANKED} SELECT pk, event_type, value, TRUE AS cleared FROM r WHERE rn = 1 AND op = 1")
def table_after_vacuum(spark, sf_dir):
    stored = stored_table(spark, sf_dir)
    old = {f.path for f in stored.snapshot().base}
    stored.compact()
    gone = set(stored.vacuum(older_than_s=0))
    return stored.scan().withColumn("cleared", F.lit(old <= gone))


@query(f"WITH {LOG}, {RANKED} SELECT pk, event_type, value, CASE WHEN seq <= {at(50)} THEN -1 ELSE 7 END::BIGINT AS grade FROM r WHERE rn = 1 AND op = 1")
def table_reopened(spark, sf_dir):
    """A table that is opened with one more column, and goes on."""
    path, (first, second) = scratch(spark, "reopened"), batches(spark, sf_dir, 2)
    KeyedTable.open(spark, path, SCHEMA, Options(compact_after=0)).write(first, order_by=["seq"], op="op")
    more = TableSchema("log", (*SCHEMA.columns, column("grade", "long", initial_default=-1, write_default=7)), ("pk",))
    again = KeyedTable.open(spark, path, more, Options(compact_after=0))
    again.write(second, order_by=["seq"], op="op")
    return again.scan()


@query(f"WITH {LOG}, {RANKED} SELECT pk, event_type, value FROM r WHERE rn = 1 AND op = 1")
def table_refreshed(spark, sf_dir):
    """A reader that was opened before the second batch and a merge."""
    first, second = batches(spark, sf_dir, 2)
    stored = KeyedTable.open(spark, scratch(spark, "refreshed"), SCHEMA, Options(compact_after=0))
    stored.write(first, order_by=["seq"], op="op")
    reader = KeyedTable.open_read_only(spark, stored.catalog_path())
    stored.write(second, order_by=["seq"], op="op")
    stored.compact()
    reader.refresh()
    return reader.scan()


@query(
    """SELECT n_nationkey AS id, upper(n_name) AS name, n_regionkey AS region FROM nation WHERE n_nationkey % 4 = 1
    UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey % 4 > 1"""
)
def database_rows(spark, sf_dir):
    """Rows in and out as dictionaries: single puts, batches and deletions by key."""
    rows = [(r.n_nationkey, r.n_name, r.n_regionkey) for r in table(spark, sf_dir, "nation").collect()]
    db = Database(scratch(spark, "database"), "nation", [("id", "int64"), ("name", "str"), ("region", "int64")], spark=spark)
    db.put_batch([{"id": i, "name": n, "region": r} for i, n, r in rows])
    db.table.apply_batch([("put", {"id": i, "name": n.upper(), "region": r}) for i, n, r in rows if i % 4 == 1])
    first = min(i for i, _, _ in rows if i % 4 == 0)
    db.delete(first)
    db.table.apply_batch([("delete", (i,)) for i, _, _ in rows if i % 4 == 0 and i != first])
    found = [(r["id"], r["name"], r["region"]) for r in db.scan()]
    assert db.get(first) is None and all(db.get(i)["name"] == n for i, n, _ in found[:1])
    return spark.createDataFrame(found, "id long, name string, region long")


@query(
    f"WITH {LOG.replace('FROM events', f'FROM events WHERE event_id < {at(40)}')}, {RANKED} "
    "SELECT pk, event_type, value FROM r WHERE rn = 1 AND op = 1"
)
def table_scan_before_base(spark, sf_dir):
    return stored_table(spark, sf_dir).scan(as_of=upto(spark, sf_dir, 40))


@query(
    _BASE + """ SELECT pk, event_type, value FROM base WHERE pk NOT IN (SELECT pk FROM tail) AND pk % 3 <> 0
    UNION ALL SELECT pk, event_type, value FROM tail WHERE op = 1"""
)
def table_position_deletes(spark, sf_dir):
    stored = stored_table(spark, sf_dir)
    base = [stored.catalog_path() + "/" + f.path for f in stored.snapshot().base]
    stored.mark_deleted(merge.with_positions(spark.read.parquet(*base)).where("pk % 3 = 0"))
    return stored.scan()


@query(f"WITH {LOG}, {RANKED} SELECT pk, event_type, value FROM r WHERE rn = 1 AND op = 1")
def mirror_scan(spark, sf_dir):
    to = scratch(spark, "mirror")
    Mirror(stored_table(spark, sf_dir), to).run()
    return KeyedTable.open_read_only(spark, to).scan()


@query(f"WITH {LOG}, {RANKED} SELECT seq, op, pk, event_type, value FROM r WHERE rn = 1")
def stream_tail(spark, sf_dir):
    stored = stored_table(spark, sf_dir)
    sink = TailSink(spark, scratch(spark, "tail"), SCHEMA)
    stream = read_log(spark, stored.catalog_path(), SCHEMA).writeStream.foreachBatch(sink)
    stream.option("checkpointLocation", scratch(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    return sink.tail()


@query(f"WITH {LOG}, {FEED} SELECT seq, op, pk, event_type, value FROM feed")
def stream_labels(spark, sf_dir):
    stored, to = stored_table(spark, sf_dir), scratch(spark, "labels")
    labelled = label_stream(read_log(spark, stored.catalog_path(), SCHEMA), SCHEMA).writeStream.format("parquet")
    labelled = labelled.option("path", to).option("checkpointLocation", scratch(spark, "progress"))
    labelled.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(to)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many keys are live, and how many operations it took."""
    state: Column = F.count("*").alias("live_keys")
    return current_state(spark, sf_dir).agg(state, F.max("seq").alias("newest_seq"))
