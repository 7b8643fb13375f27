"""Bars: the long fact table (symbol, ts, open, high, low, close, volume) and how it is built, read and written."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType, TimestampNTZType
from pyspark.sql.window import Window

BAR_SCHEMA = StructType(
    [StructField("symbol", StringType()), StructField("ts", TimestampNTZType())]
    + [StructField(c, DoubleType()) for c in ("open", "high", "low", "close", "volume")]
)
#: Names under which a file may hold its time column, in the order in which they are looked for.
TIME_NAMES = ("date", "timestamp", "time", "datetime")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df itself, or a ValueError naming what it lacks. Reads the schema only."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def build_bars(ticks: DataFrame, symbol: Column, ts: Column, price: Column, volume: Column, order: Sequence[str]) -> DataFrame:
    """Bars from ticks: one partial aggregation before the shuffle, one after. `order` decides the first and the last tick."""
    place = F.struct(*order)
    return ticks.groupBy(symbol.alias("symbol"), ts.cast("timestamp_ntz").alias("ts")).agg(
        F.min_by(price, place).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, place).alias("close"),
        volume.cast("double").alias("volume"),
    )


def event_bars(events: DataFrame, unit: str = "hour") -> DataFrame:
    """Bars of the events' values, one symbol for each event type."""
    return build_bars(events.where(F.col("value") > 0), F.col("event_type"), F.date_trunc(unit, "ts"), F.col("value"), F.count("*"), ("ts", "event_id"))


def line_bars(lineitem: DataFrame, unit: str = "day") -> DataFrame:
    """Bars of the unit prices of lineitem, one symbol for each return flag."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    order = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    if unit != "day":  # the day decides first; within it the keys do
        order = ("l_shipdate", *order)
    return build_bars(lineitem, F.col("l_returnflag"), F.date_trunc(unit, "l_shipdate"), price, F.sum("l_quantity"), order)


def read_csv_bars(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """One symbol's CSV with a header in any case; its time column is the first of TIME_NAMES that it has."""
    raw = spark.read.option("header", True).csv(path)
    raw = raw.toDF(*[c.lower() for c in raw.columns])
    time = next((c for c in TIME_NAMES if c in raw.columns), None)
    if time is None:
        raise ValueError(f"no time column among {', '.join(raw.columns)}")
    require_columns(raw, ("open", "high", "low", "close", "volume"))
    return raw.select(F.lit(symbol).alias("symbol"), F.to_timestamp_ntz(time).alias("ts"), *[F.col(c).cast("double") for c in ("open", "high", "low", "close", "volume")])


def write_bars(bars: DataFrame, path: str, interval: str) -> None:
    """Parquet by symbol, interval, year and month; a rewrite replaces the partitions that it has rows for."""
    name = F.regexp_replace(F.col("symbol"), "[/-]", "_")
    (
        bars.withColumn("symbol", name)
        .withColumns({"interval": F.lit(interval), "year": F.year("ts"), "month": F.month("ts")})
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("symbol", "interval", "year", "month")
        .parquet(path)
    )


def read_bars(spark: SparkSession, path: str, symbols: Sequence[str], interval: str, start: str, end: str) -> DataFrame:
    """Bars of a range of time, both ends included; an end at midnight means the end of that day. Of bars with the same ts the first stays.

    Symbol, interval, year and month prune folders, ts is pushed to the scan.
    """
    names = [s.replace("/", "_").replace("-", "_") for s in symbols]
    lo, hi = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    last = F.when(F.date_trunc("day", hi) == hi, hi + F.expr("interval 1 day") - F.expr("interval 1 microsecond")).otherwise(hi)
    bars = spark.read.parquet(path).where(F.col("symbol").isin(*names) & (F.col("interval") == interval))
    month = F.col("year") * 12 + F.col("month")
    bars = bars.where((month >= F.year(lo) * 12 + F.month(lo)) & (month <= F.year(last) * 12 + F.month(last))).where(F.col("ts").between(lo, last))
    return keep_first(bars.select(*BAR_SCHEMA.names), ("symbol", "ts"), ("open", "high", "low", "close", "volume"))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key, the first by `order`."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def aligned(bars: DataFrame, symbols: Sequence[str], column: str = "close") -> DataFrame:
    """One column for each symbol, over the times at which all of them have a value."""
    wide = bars.where(F.col("symbol").isin(*symbols)).groupBy("ts").pivot("symbol", list(symbols)).agg(F.first(column))
    return wide.na.drop()
