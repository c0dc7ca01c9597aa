import os

from pyspark.sql import functions as F

from tidelog.schema import TableSchema, column
from tidelog.sources.table import KeyedTable, Options
from tidelog.streaming.tail import TailSink, counts_by_window, label_stream, read_log

SCHEMA = TableSchema("t", (column("id", "long", nullable=False), column("v", "long")), ("id",))


def filled(spark, path):
    t = KeyedTable.open(spark, path, SCHEMA, Options(compact_after=0))
    for k in range(3):
        t.apply_batch([("put", {"id": i, "v": k}) if (i + k) % 3 else ("delete", (i,)) for i in range(8)])
    return t


def test_tail_sink_is_the_newest_of_each_key(spark, tmp_path):
    t = filled(spark, f"{tmp_path}/t")
    sink = TailSink(spark, f"{tmp_path}/tail", SCHEMA)
    stream = read_log(spark, f"{tmp_path}/t", SCHEMA, max_files=1)
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    live = sorted((r.id, r.v) for r in sink.tail().where("op = 1").collect())
    assert live == [(r.id, r.v) for r in t.scan().collect()] and sink.last_epoch >= 2
    before = sorted(map(tuple, sink.tail().collect()))
    sink(t.operations(), 99)  # delivered again
    assert sorted(map(tuple, sink.tail().collect())) == before


def test_stream_labels_equal_the_feed(spark, tmp_path):
    t = filled(spark, f"{tmp_path}/t")
    labelled = label_stream(read_log(spark, f"{tmp_path}/t", SCHEMA), SCHEMA)
    q = (
        labelled.writeStream.format("memory").queryName("labelled").outputMode("append")
        .option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    )
    q.awaitTermination(180)
    got = sorted(map(repr, map(tuple, spark.table("labelled").select("seq", "op", "id", "v").collect())))
    assert got == sorted(map(repr, map(tuple, t.changes().select("seq", "op", "id", "v").collect())))


def run(stream, sink, checkpoint):
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination(120)


def test_tail_sink_goes_on_after_a_restart(spark, tmp_path):
    t, path, made = filled(spark, f"{tmp_path}/t"), f"{tmp_path}/tail", 0
    for k in range(5):
        sink = TailSink(spark, path, SCHEMA, merge_every=2)  # a new process knows nothing but the folder
        assert sink.last_epoch == made - 1
        run(read_log(spark, f"{tmp_path}/t", SCHEMA), sink, f"{tmp_path}/c")
        made = sink.last_epoch + 1
        live = sorted((r.id, r.v) for r in sink.tail().where("op = 1").collect())
        assert live == [(r.id, r.v) for r in t.scan().collect()]
        t.apply_batch([("put", {"id": 100 + k, "v": k}), ("delete", (k,))])
    assert made == 5
    before = sorted(map(tuple, sink.tail().collect()))
    sink(t.operations(), 2)  # an old batch again
    torn = f"{path}/part-{9:012d}-{'0' * 32}"
    t.operations().write.parquet(torn)
    os.remove(f"{torn}/_SUCCESS")  # its writer died
    again = TailSink(spark, path, SCHEMA, merge_every=2)
    assert sorted(map(tuple, again.tail().collect())) == before and again.last_epoch == 4
    for e in range(5, 9):
        again(t.operations(), e)
    # the merged copy, the part after it, and the three that the last merge replaced
    assert len([f for f in os.listdir(path) if not f.startswith("part-000000000009")]) == 5


def test_labels_keep_every_value(spark, tmp_path):
    s = TableSchema(
        "w", (column("k", "double", nullable=False), column("n", "long"), column("x", "double"), column("b", "binary"), column("o", "boolean"), column("i", "int"), column("f", "float"), column("t", "string")), ("k",)
    )
    t = KeyedTable.open(spark, f"{tmp_path}/t", s, Options(compact_after=0))
    big = 9007199254740993
    t.put_batch([
        {"k": 0.0, "n": big, "x": float("nan"), "b": b"\0\xff", "o": True, "i": -5, "f": 0.1, "t": ""}, {"k": -0.0, "n": None, "x": -0.0, "t": "\n,"},
        {"k": 1.5, "n": big + 2, "x": 1e-320}, {"k": 0.0, "n": None, "x": float("inf"), "o": False}, {"k": 0.0, "n": -big},
    ])
    t.apply_batch([("delete", (0.0,)), ("put", {"k": -0.0, "n": 2**63 - 1}), ("delete", (1.5,)), ("delete", (1.5,))])
    q = (
        label_stream(read_log(spark, f"{tmp_path}/t", s, max_files=1), s).writeStream.format("parquet").option("path", f"{tmp_path}/o")
        .option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    )
    q.awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/o")
    want = t.changes().drop("pk_bytes")
    assert got.dtypes == want.dtypes
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and any(r.n == big for r in got.collect())


def test_windows(spark, tmp_path):
    t = filled(spark, f"{tmp_path}/t")
    timed = t.operations().withColumn("at", F.timestamp_seconds(F.col("seq")))
    found = counts_by_window(timed, "at", "10 seconds", "1 minute").groupBy().agg(F.sum("n").alias("n")).first()
    assert found.n == 24
