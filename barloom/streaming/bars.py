"""Bars and sessions from a stream of ticks. An extension: what it computes on a finished stream equals the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(ticks: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Bars of (ts, event_id, symbol, price) with a watermark; a bar is final once the watermark has passed its end. Later ticks are dropped."""
    place = F.struct("ts", "event_id")
    bars = ticks.withWatermark("ts", late).groupBy(F.window("ts", every), "symbol").agg(
        F.min_by("price", place).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", place).alias("close"), F.count("*").cast("double").alias("volume")
    )
    return bars.select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")


def sliding_volume(ticks: DataFrame, length: str = "6 hours", step: str = "1 hour", late: str = "2 hours") -> DataFrame:
    sums = ticks.withWatermark("ts", late).groupBy(F.window("ts", length, step), "symbol").agg(F.count("*").alias("ticks"), F.sum("price").alias("total"))
    return sums.select("symbol", F.col("window.start").alias("ts"), "ticks", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """One row for each run of a user's events with gaps below `gap`."""
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return s.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events", "total")
