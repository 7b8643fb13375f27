"""Streams in append mode: windows come out once the watermark has passed them, and what is too late is dropped."""

from __future__ import annotations

from datetime import datetime
from pathlib import Path

from pyspark.sql import functions as F

from barloom.plans import q_sources
from barloom.streaming.bars import sessions, stream_bars

SCHEMA = "ts timestamp, event_id long, symbol string, price double"


def test_bars_in_append_mode(spark, tmp_path):
    at = lambda h, m: datetime(2024, 1, 1, h, m)
    batches = [
        [(at(0, 5), 1, "a", 10.0), (at(0, 50), 2, "a", 12.0), (at(1, 10), 3, "a", 9.0)],
        [(at(0, 30), 4, "a", 20.0), (at(4, 0), 5, "a", 5.0)],  # half an hour late, but not too late; then on past the first bars
        [(at(0, 40), 6, "a", 99.0), (at(9, 0), 7, "a", 6.0)],  # too late
        [(at(20, 0), 8, "a", 7.0)],
    ]
    out = {}
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        ticks = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        query = stream_bars(ticks).writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/marks").option("path", f"{tmp_path}/out").format("parquet").trigger(availableNow=True).start()
        query.awaitTermination()
        out[k] = spark.read.schema("symbol string, ts timestamp, open double, high double, low double, close double, volume double").parquet(f"{tmp_path}/out").orderBy("ts").collect()
    bars = [(r.ts.hour, r.open, r.high, r.low, r.close, r.volume) for r in out[3]]
    assert not out[0]
    assert bars == [(0, 10.0, 20.0, 10.0, 12.0, 3.0), (1, 9.0, 9.0, 9.0, 9.0, 1.0), (4, 5.0, 5.0, 5.0, 5.0, 1.0), (9, 6.0, 6.0, 6.0, 6.0, 1.0)]


def test_tasks_of_a_streamed_table_stay_small(spark, tmp_path, monkeypatch):
    """Ten times what a task may read or merge goes to ten tasks and more, not to one; state lies on disk."""
    made, folder = {}, q_sources.folder
    monkeypatch.setattr(q_sources, "_TASK_ROWS", 300, raising=False)
    monkeypatch.setattr(q_sources, "folder", lambda spark, name: made.setdefault(name, folder(spark, name)))
    # Each of 1,000 users has events at 0, 20 and 90 minutes: two sessions. Late and early times are in all files.
    k = F.col("id")
    at = F.timestamp_seconds(1_700_000_000 + F.floor(k / 3) * 60 + F.element_at(F.array(*map(F.lit, (0, 1200, 5400))), (k % 3 + 1).cast("int")))
    rows = spark.range(3000).select(k.alias("event_id"), at.cast("timestamp_ntz").alias("ts"), F.floor(k / 3).alias("user_id"), F.lit("a").alias("event_type"), F.lit(1.0).alias("value")).orderBy(F.hash("event_id"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")

    out = q_sources._streamed(spark, str(tmp_path), lambda ticks: ticks.select("symbol", F.spark_partition_id().alias("task")))
    read = {r.task: r["count"] for r in out.where("symbol = 'a'").groupBy("task").count().collect()}
    assert sum(read.values()) == 3000 and max(read.values()) <= 300

    made.clear()
    out = q_sources._streamed(spark, str(tmp_path), lambda ticks: sessions(ticks).withColumn("task", F.spark_partition_id())).where("user_id is not null")
    assert {(r.events, r.total): r["count"] for r in out.groupBy("events", "total").count().collect()} == {(2, 2.0): 1000, (1, 1.0): 1000}
    assert out.select("user_id", "start").distinct().count() == 2000
    assert out.select("task").distinct().count() == 10
    assert list(Path(made["stream-marks"].removeprefix("file:")).glob("state/0/*/*.zip"))
