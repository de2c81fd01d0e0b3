"""Streams against their batch twins: audits that end or run out, panes with quantile sketches."""

import random

import pytest
from pyspark.sql import functions as F

from docaudit.operators import monitor
from docaudit.streaming import monitor as stream

SCHEMA = "event_id long, user_id long, event_type string, value double, ts timestamp"
HOUR = 3600


def event_table(spark, rows):
    return spark.createDataFrame([(i, u, k, float(i), t) for i, u, k, t in rows], "event_id long, user_id long, event_type string, value double, at long").select("event_id", "user_id", "event_type", "value", F.timestamp_seconds("at").alias("ts"))


def cells(df):
    return sorted((r.user_id, r.began.timestamp(), r.seconds is None or r.seconds, r.finished) for r in df.collect())


def test_pairs_in_order_of_time(spark):
    rows = [(1, 1, "start", 0), (2, 2, "finish", 5), (3, 1, "finish", 9), (4, 1, "start", 10), (5, 1, "start", 11), (6, 1, "finish", 12), (7, 1, "finish", 20), (8, 3, "start", 1), (9, 3, "finish", 2 * HOUR), (10, 4, "start", 0), (11, None, "start", 0), (12, 5, "start", 0), (13, 5, "other", 1)]
    d = event_table(spark, rows)
    ended = sorted((r.user_id, r.seconds, r.finished) for r in stream.pair_each_audit(d, "start", "finish", "1 hour").collect() if r.finished)
    assert ended == [(1, 2.0, True), (1, 9.0, True), (1, 9.0, True), (2, 0.0, True), (3, 0.0, True)]  # 3: its start had run out
    late = stream.pair_each_audit(d, "start", "finish", "1 hour", now="1970-01-01 02:00:00").where("not finished")
    assert sorted((r.user_id, r.seconds) for r in late.collect()) == [(3, None), (4, None), (5, None)]
    assert stream.pair_each_audit(d.where("1 = 0"), "start", "finish").count() == 0


def test_stream_of_pairs_equals_batch_on_shuffled_input(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(i, rnd.randrange(12), rnd.choice(["start", "finish", "start", "other"]), rnd.randrange(6 * HOUR)) for i in range(240)]
    rnd.shuffle(rows)
    end = [(9999, 77, "start", 48 * HOUR)]
    for i in range(4):
        event_table(spark, rows[i::4]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        run = lambda: stream.stream_pair_audits(source(), "start", "finish", "1 hour", "12 hours").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q = run()
        q.awaitTermination(200)
        assert q.exception() is None and spark.read.parquet(str(tmp_path / "out")).count() == 0  # nothing is final yet
        event_table(spark, end).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # the watermark passes all others
        q = run()  # goes on from the checkpoint
        q.awaitTermination(200)
        got = spark.read.parquet(str(tmp_path / "out"))
        want = stream.pair_each_audit(event_table(spark, rows + end), "start", "finish", "1 hour", now="1970-01-02 12:00:00")
        assert cells(got) == cells(want) and got.where("not finished").count() > 0
        states = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
        assert states[-1] <= 4  # only the last start waits, with its timer: nothing of 240 events is left
    finally:
        spark.conf.unset(name)


def ranks(values, x):
    return sum(v < x for v in values) / len(values), sum(v <= x for v in values) / len(values)


def test_quantile_sketches_keep_their_rank_error(spark):
    rnd = random.Random(3)
    rows = [(i, 1, rnd.choice("ab"), rnd.randrange(4 * HOUR)) for i in range(6000)]
    d = event_table(spark, rows).withColumn("value", F.exp(F.col("value") % 997 / 100)).repartition(6).cache()
    exact = {r.event_type: sorted(r.v) for r in d.groupBy("event_type").agg(F.collect_list("value").alias("v")).collect()}
    for r in monitor.stage_stats(d, approximate=True).collect():
        low, high = ranks(exact[r.event_type], r.p95)
        assert low - monitor.RANK_ERROR * 2 <= 0.95 <= high + monitor.RANK_ERROR * 2 and r.n == len(exact[r.event_type])
    stored = monitor.panes(d, "30 minutes", good=F.col("event_id") % 2 == 0)
    at = F.unix_seconds("ts")
    for slide in ("1 hour", "30 minutes"):  # tumbling and sliding, both from the same panes
        for r in monitor.merged_panes(stored, "1 hour", slide).collect():
            began = int(r.began.timestamp())
            inside = d.where((at >= began) & (at < began + HOUR) & (F.col("event_type") == r.event_type))
            if began % (2 * HOUR) == 0:
                values = [x.value for x in inside.collect()]
                low, high = ranks(values, r.p95)
                assert r.n == len(values) and low - 0.03 <= 0.95 <= high + 0.03
                assert r.success_rate == pytest.approx(round(100 * inside.where("event_id % 2 = 0").count() / r.n, 1), abs=0.11)
    none = monitor.stage_stats(d.withColumn("value", F.lit(None).cast("double")), approximate=True).collect()
    assert all(r.p95 is None for r in none)


def test_stream_of_panes_equals_batch(spark, tmp_path):
    d = event_table(spark, [(i, 1, "ab"[i % 2], i * 60) for i in range(300)])
    d.write.parquet(str(tmp_path / "in"))
    q = stream.stream_panes(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), "30 minutes", "1 hour").writeStream.format("memory").queryName("panes").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    figures = lambda df: sorted(map(tuple, monitor.pane_figures(df).collect()))
    assert figures(spark.table("panes")) == figures(monitor.panes(d, "30 minutes")) and spark.table("panes").count() > 10


def test_audits_of_several_keys_are_one_frame():
    got = stream._paired("user_id", [7, 8, 8], [(0, 1.5), (1_000_000, None), (2_000_000, 0.0)])
    assert got["user_id"].tolist() == [7, 8, 8] and got["finished"].tolist() == [True, False, True]
    pairing = stream.Pairing([1, 2, 50], 10)
    assert pairing.until(12) == [(1, None), (2, None)] and pairing.opened == [50] and pairing.until(59) == []
