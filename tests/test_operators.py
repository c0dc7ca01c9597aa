import random

import pytest
from pyspark.sql import functions as F

from tidelog.errors import BelowRetentionError
from tidelog.operators import feed, merge, overlay, picker, resolve

COLUMNS = "seq long, op int, id long, v long"


def ops(spark, *rows):
    return spark.createDataFrame([r if len(r) == 4 else (*r, None) for r in rows], COLUMNS)


def labelled(spark, rows, **how):
    found = feed.change_feed(ops(spark, *rows), ["id"], **how).orderBy("seq").collect()
    return [(r.seq, r.op, r.id, r.v) for r in found]


def test_labels_and_pre_images(spark):
    assert labelled(spark, [(1, 1, 1, 5), (2, 1, 1, 6), (3, 1, 2, 7)]) == [
        (1, "INSERT", 1, 5), (2, "UPDATE", 1, 6), (3, "INSERT", 2, 7),
    ]
    assert labelled(spark, [(1, 1, 42, 9999), (2, 0, 42)])[1] == (2, "DELETE", 42, 9999)
    assert labelled(spark, [(1, 0, 999)]) == [(1, "DELETE", None, None)]
    twice = [(1, 1, 1, 5), (2, 0, 1), (3, 0, 1), (4, 1, 1, 6)]
    assert labelled(spark, twice)[1:] == [(2, "DELETE", 1, 5), (3, "DELETE", None, None), (4, "INSERT", 1, 6)]
    assert labelled(spark, twice, since=1)[0] == (2, "DELETE", 1, 5)
    assert labelled(spark, [(1, 1, 1, 1), (2, 1, 1, 2)], discriminate=False)[1][1] == "INSERT"
    with pytest.raises(BelowRetentionError) as e:
        labelled(spark, twice, since=1, low_water=2)
    assert (e.value.requested, e.value.low_water) == (1, 2)


def random_log(seed, n=300, keys=12):
    r = random.Random(seed)
    return [(i, int(r.random() > 0.3), r.randrange(keys), r.randrange(100)) for i in range(1, n + 1)]


def model(rows, upto):
    live = {}
    for seq, op, k, v in rows:
        if seq <= upto:
            live.pop(k, None)
            if op:
                live[k] = v
    return live


@pytest.mark.parametrize("seed", range(3))
def test_random_logs(spark, seed):
    rows = random_log(seed)
    df = ops(spark, *rows)
    state = {r.id: r.v for r in resolve.current_state(df, ["id"]).collect()}
    assert state == model(rows, 300)
    assert {r.id: r.v for r in resolve.current_state(df, ["id"], as_of=120).collect()} == model(rows, 120)
    cut = 50 + 70 * seed
    over = overlay.overlay(resolve.current_state(df, ["id"], cut), df.where(f"seq > {cut}"), ["id"])
    assert {r.id: r.v for r in over.collect()} == state
    whole = labelled(spark, rows)
    assert labelled(spark, rows, since=cut) == whole[cut:]
    assert labelled(spark, rows, split_every=40) == whole
    assert labelled(spark, rows, since=cut, until=cut + 60, split_every=17) == whole[cut : cut + 60]


def test_negative_zero_is_a_key_of_its_own(spark):
    df = spark.createDataFrame([(1, 1, 0.0), (2, 1, -0.0), (3, 1, 0.0)], "seq long, op int, k double")
    assert sorted(r.seq for r in resolve.current_state(df, ["k"]).collect()) == [2, 3]
    assert [r.seq for r in resolve.point_lookup(df, ["k"], (-0.0,)).collect()] == [2]


def test_ranges(spark):
    df = ops(spark, *[(i, 1, i, i) for i in range(1, 11)])
    get = lambda a, b: [r.id for r in resolve.range_scan(df, ["id"], a, b, ordered=True).collect()]
    assert get((3,), (6,)) == [3, 4, 5] and get(None, (3,)) == [1, 2] and get((9,), None) == [9, 10] and get((4,), (4,)) == []
    two = spark.createDataFrame([(i * 10 + j, 1, i, j) for i in range(4) for j in range(4)], "seq long, op int, a int, b int")
    found = resolve.range_scan(two, ["a", "b"], (1, 2), (3, 1)).collect()
    assert {(r.a, r.b) for r in found} == {(i, j) for i in range(4) for j in range(4) if (1, 2) <= (i, j) < (3, 1)}


def kept(spark, rows, **how):
    return sorted(r.seq for r in merge.compact(ops(spark, *rows), ["id"], **how).collect())


def test_compaction_rules(spark):
    rows = [(1, 1, 1, 0), (2, 1, 1, 1), (3, 0, 1), (4, 1, 2, 0), (5, 1, 2, 1)]
    assert kept(spark, rows) == [3, 5]
    assert kept(spark, rows, drop_deletions=True) == [5]
    assert kept(spark, rows, oldest_snapshot=2) == [2, 3, 4, 5]
    assert kept(spark, rows, oldest_snapshot=4, drop_deletions=True) == [4, 5]
    assert kept(spark, rows, oldest_snapshot=3, drop_deletions=True) == [3, 4, 5]
    assert not merge.drops_deletions(4, 4) and merge.drops_deletions(5, 4)


def test_position_cardinality(spark, tmp_path):
    rounds, n = 5, 40
    frames = []
    for k in range(rounds):
        path = f"{tmp_path}/f{k}"
        ops(spark, *[(k * n + i + 1, 1, i, k) for i in range(n)]).coalesce(1).write.parquet(path)
        frames.append(merge.with_positions(spark.read.parquet(path)))
    marked = None
    for k in range(1, rounds):
        before = frames[0]
        for f in frames[1:k]:
            before = before.union(f)
        new = merge.superseded(before, ["id"], frames[k], marked)
        marked = new if marked is None else merge.union_positions(marked, new)
    assert marked.count() == (rounds - 1) * n
    everything = frames[0]
    for f in frames[1:]:
        everything = everything.union(f)
    assert {(r.id, r.v) for r in merge.without_positions(everything, marked).collect()} == {(i, rounds - 1) for i in range(n)}


def info(path, level, bytes=10, lo=b"a", hi=b"b", seq=1):
    return picker.FileInfo(path, level, bytes, 1, seq, seq, lo, hi)


def test_picker():
    p = picker.Policy(l0_trigger=2, l0_slowdown=5, level_bytes=(100, 1000), max_bytes=25)
    assert picker.pick([info("a", 0)], p) is None
    files = [info("b", 0, seq=2), info("a", 0, seq=1), info("c", 0, seq=3), info("x", 1, lo=b"b", hi=b"c"), info("y", 1, lo=b"d", hi=b"e")]
    got = picker.pick(files, p)
    assert [f.path for f in got.inputs] == ["a", "b"] and [f.path for f in got.overlaps] == ["x"]
    assert (got.level, got.output_level, got.drop_deletions) == (0, 1, False)
    assert picker.pick(files, p, busy={1}) is None
    big = [info("l", 1, bytes=500)]
    assert picker.pick([*files, *big], p).level == 1  # five times over its limit
    assert picker.pick([*[info(str(i), 0, seq=i) for i in range(5)], *big], p).level == 0  # forced
    assert [f.path for f in picker.take([info("z", 0, bytes=99)], p)] == ["z"]
    deep = picker.pick([info("m", 2, bytes=5000)], p)
    assert deep.drop_deletions and deep.output_level == 3


def test_cursor(spark):
    rows = [(i, 1, i, i) for i in range(1, 251)]
    df = ops(spark, *rows)
    cursor = feed.Cursor(lambda s: feed.change_feed(df, ["id"], since=s))
    seen, sizes = [], []
    while page := cursor.next_batch(7):
        seen += [r.seq for r in page]
        sizes.append(len(page))
    assert seen == list(range(1, 251)) and set(sizes[:-1]) == {7} and cursor.since_seq == 250
    assert cursor.next_batch(7) == [] and cursor.buffered_len() == 0 and cursor.next_batch(0) == []


def test_cursor_scans_do_not_grow_with_pages(spark):
    written, scans = [5000], []

    def changes(since):
        scans.append(since)
        ops = spark.range(1, written[0] + 1).select(F.col("id").alias("seq"), F.lit(1).alias("op"), (F.col("id") % 90).alias("id"))
        return feed.change_feed(ops, ["id"], since=since)

    cursor, pages = feed.Cursor(changes), []
    while page := cursor.next_batch(7):
        pages.append([r["seq"] for r in page])
    assert sum(pages, []) == list(range(1, 5001))
    assert {len(p) for p in pages[:-1]} == {7}
    assert scans == [0, 1024, 5000]  # the first pages, the rest, the head
    written[0] = 5003
    assert [r["seq"] for r in cursor.next_batch(7)] == [5001, 5002, 5003] and cursor.since_seq == 5003
