"""Streams of outcomes: state, restarts, late outcomes and timers; observed counters."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from catalith.operators import relations
from catalith.streaming import refresh, stateful

T0 = datetime(2024, 1, 1)
SCHEMA = "user long, ts timestamp, v double, kind string"


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def feed(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
    source = spark.readStream.schema(SCHEMA).parquet(f"{path}/in")
    return source


def test_state_survives_and_order_does_not_matter(spark, tmp_path):
    rows = [(1, at(3), 3.0, "ok"), (1, at(1), 1.0, "ok"), (2, at(2), 9.0, "error"), (2, at(1), 4.0, "ok"), (3, at(5), None, "ok"), (3, at(5), 2.0, "ok"), (4, at(6), 1.0, "ok"), (4, at(6), 2.0, "error"), (1, at(9), 5.0, "error"), (2, at(0), 7.0, "ok")]
    for part in (rows[:4], rows[4:7], rows[7:]):
        source = feed(spark, tmp_path, part)
        stateful.start(source, f"{tmp_path}/out", f"{tmp_path}/check", "user", "ts", "v", F.col("kind") == "error").awaitTermination()
    got = {r.id: (r.value, r.stale, r.n_refreshed, r.n_failed) for r in stateful.latest(spark, f"{tmp_path}/out").collect()}
    assert got == {1: (3.0, True, 2, 1), 2: (4.0, True, 2, 1), 3: (2.0, False, 2, 0), 4: (1.0, True, 1, 1)}
    # a micro-batch writes the entities that it has outcomes for
    stateful.start(feed(spark, tmp_path, [(3, at(20), 8.0, "ok")]), f"{tmp_path}/out", f"{tmp_path}/check", "user", "ts", "v", F.col("kind") == "error").awaitTermination()
    last = spark.read.parquet(f"{tmp_path}/out")
    newest = last.agg(F.max("batch")).first()[0]
    assert [r.id for r in last.where(F.col("batch") == newest).collect()] == [3]
    batch = relations.last_good(spark.read.parquet(f"{tmp_path}/in"), "user", "ts", "v", F.col("kind") == "error")
    assert {(r.user, r.value, r.n_refreshed, r.n_failed) for r in batch.collect()} == {(r.id, r.value, r.n_refreshed, r.n_failed) for r in stateful.latest(spark, f"{tmp_path}/out").collect()}


def test_a_timer_marks_what_never_came_again(spark, tmp_path):
    run = lambda rows: stateful.start(feed(spark, tmp_path, rows), f"{tmp_path}/out", f"{tmp_path}/check", "user", "ts", "v", F.col("kind") == "error", expire="30 minutes", late="5 minutes").awaitTermination()
    run([(1, at(0), 1.0, "ok"), (2, at(0), 2.0, "ok")])
    run([(2, at(25), 3.0, "ok")])
    run([(3, at(50), 4.0, "ok")])
    run([(1, at(1), 99.0, "ok")])  # older than the watermark: dropped
    got = {r.id: (r.value, r.stale, r.n_refreshed) for r in stateful.latest(spark, f"{tmp_path}/out").collect()}
    assert got == {1: (1.0, True, 1), 2: (3.0, False, 2), 3: (4.0, False, 1)}


def test_windows_of_a_stream(spark, tmp_path):
    source = feed(spark, tmp_path, [(1, at(0), 1.0, "ok"), (1, at(9), 1.0, "error"), (1, at(10), 1.0, "ok"), (1, at(60), 1.0, "ok")])
    windows = refresh.event_windows(source.withColumnRenamed("kind", "event_type"))
    query = windows.writeStream.outputMode("complete").format("memory").queryName("event_windows_test").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r.window.start, r.n_failed, r.n_refreshed) for r in spark.table("event_windows_test").collect())
    assert [x[1:] for x in got] == [(1, 1), (0, 1), (0, 1)]


def test_counters_are_observed(spark, tmp_path):
    df, seen = relations.counted(spark.createDataFrame([(1, None), (2, "x"), (3, None)], "id int, failure string"))
    df.write.parquet(str(tmp_path / "t"))
    assert seen.get == {"n": 3, "n_failed": 1, "n_refreshed": 2}
    empty, none = relations.counted(df.limit(0))
    empty.write.parquet(str(tmp_path / "e"))
    assert none.get == {"n": 0, "n_failed": 0, "n_refreshed": 0}
