import pytest

from tidelog.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_its_sql(spark, sf_dir, same, name):
    same(QUERIES[name](spark, sf_dir), ORACLES[name])


def test_entry(spark):
    import __spark_entry__

    row = __spark_entry__.entry(spark).first()
    assert row["live_keys"] == 12  # known of this table
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_bounds_on_seq_reach_the_scan(spark, sf_dir, tmp_path):
    from tidelog.operators.feed import change_feed
    from tidelog.plans.queries import log

    log(spark, sf_dir).write.parquet(f"{tmp_path}/log")
    plan = change_feed(spark.read.parquet(f"{tmp_path}/log"), ["pk"], since=900)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(seq,900)" in plan and "LessThanOrEqual(seq,900)" in plan


def test_bounds_of_batches_reach_the_scan(spark, sf_dir):
    from tidelog.plans.queries import batches

    plan = batches(spark, sf_dir, 4)[1]._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(event_id,250)" in plan and "LessThan(event_id,500)" in plan


def test_range_bounds_reach_the_scan(spark, sf_dir):
    plan = QUERIES["range_scan"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(user_id,3)" in plan and "LessThan(user_id,90)" in plan


def test_bench_gives_no_rates_of_partial_queries():
    import bench

    seconds = dict.fromkeys([*bench.HEADLINE, "stored_scan"], 0.5)
    whole = {"current_state", "feed_all", "tail_over_base", "compact_keep_latest", "file_stats", "stored_scan"}
    assert bench.rates(seconds, 100) == dict.fromkeys(whole, 200)
