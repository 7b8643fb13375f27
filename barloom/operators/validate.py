"""Data checks: each is one aggregate that yields (subject, check, level, failed)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

INF = float("inf")


def _report(grouped: DataFrame, key: str, checks: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """grouped: an aggregate with what the conditions name. A condition that is null has not failed."""
    rows = [F.struct(F.lit(name).alias("check"), F.lit(level).alias("level"), F.coalesce(failed, F.lit(False)).alias("failed")) for name, (level, failed) in checks.items()]
    return grouped.select(F.col(key).alias("subject"), F.explode(F.array(*rows)).alias("c")).select("subject", "c.*")


def returns(df: DataFrame, key: str = "symbol", value: str = "ret", least: int = 30) -> DataFrame:
    v = F.col(value)
    g = df.groupBy(key).agg(F.count("*").alias("n"), F.count_if(v.isNull() | F.isnan(v)).alias("nulls"), F.count_if(F.abs(v) == INF).alias("infinite"), F.max(v).alias("hi"), F.min(v).alias("lo"), F.stddev_samp(v).alias("sd"))
    c = F.col
    return _report(g, key, {
        "too_few": ("error", c("n") < least), "nulls": ("error", c("nulls") > 0), "infinite": ("error", c("infinite") > 0),
        "above_100_percent": ("warning", c("hi") > 1), "below_minus_100_percent": ("warning", c("lo") < -1), "constant": ("warning", c("sd") == 0),
    })


def prices(df: DataFrame, key: str = "symbol", value: str = "close") -> DataFrame:
    v = F.col(value)
    g = df.groupBy(key).agg(F.count("*").alias("n"), F.count_if(v.isNull() | F.isnan(v)).alias("nulls"), F.count_if(F.abs(v) == INF).alias("infinite"), F.count_if(v < 0).alias("negative"), F.count_if(v == 0).alias("zero"), F.max(v).alias("hi"), F.min(v).alias("lo"))
    c = F.col
    return _report(g, key, {"empty": ("error", c("n") == 0), "nulls": ("error", c("nulls") > 0), "infinite": ("error", c("infinite") > 0), "negative": ("error", c("negative") > 0), "zero": ("warning", c("zero") > 0), "constant": ("warning", c("hi") == c("lo"))})


def weights(df: DataFrame, key: str = "portfolio", leverage: float = 1.0, short: bool = False) -> DataFrame:
    w = F.col("w")
    g = df.groupBy(key).agg(F.count_if(w.isNull() | F.isnan(w)).alias("nulls"), F.count_if(F.abs(w) == INF).alias("infinite"), F.count_if(w < 0).alias("negative"), F.sum(w).alias("total"), F.sum(F.abs(w)).alias("gross"))
    c = F.col
    return _report(g, key, {"nulls": ("error", c("nulls") > 0), "infinite": ("error", c("infinite") > 0), "negative": ("error", (c("negative") > 0) & F.lit(not short)), "not_one": ("error", F.abs(c("total") - 1) > 1e-6), "leverage": ("error", c("gross") > leverage + 1e-6)})


def dates(df: DataFrame, key: str = "symbol", ts: str = "ts", ordinal: str = "t") -> DataFrame:
    """ordinal: the order in which rows came, by which they should be in time."""
    w = Window.partitionBy(key).orderBy(ordinal)
    d = df.withColumn("_before", F.lag(ts).over(w))
    g = d.groupBy(key).agg(F.count_if(F.col(ts).isNull()).alias("nulls"), F.count_if(F.col("_before") > F.col(ts)).alias("backwards"), (F.count(ts) - F.count_distinct(ts)).alias("repeated"))
    return _report(g, key, {"nulls": ("error", F.col("nulls") > 0), "unsorted": ("error", F.col("backwards") > 0), "repeated": ("error", F.col("repeated") > 0)})


def trades(df: DataFrame, key: str = "symbol", quantity: str = "size", price: str = "entry_price", side: str = "direction", sides: Sequence = (1, -1)) -> DataFrame:
    g = df.groupBy(key).agg(F.count_if(F.col(quantity) == 0).alias("q"), F.count_if(F.col(price) <= 0).alias("p"), F.count_if(~F.col(side).isin(*sides)).alias("s"))
    return _report(g, key, {"no_quantity": ("error", F.col("q") > 0), "price": ("error", F.col("p") > 0), "side": ("error", F.col("s") > 0)})


def metrics(df: DataFrame, key: str = "symbol") -> DataFrame:
    c = F.col
    return _report(df, key, {"sharpe": ("warning", F.abs(c("sharpe")) > 5), "total_return": ("warning", c("total_return") > 10), "volatility": ("warning", c("volatility") > 2), "drawdown": ("warning", c("max_drawdown") < -0.9)})


def parameters(given: Mapping[str, float], bounds: Mapping[str, tuple[float, float]]) -> list[str]:
    """What is wrong with a rule's parameters: names that are missing, and values out of bounds."""
    wrong = [f"{n} is missing" for n in bounds if n not in given]
    return wrong + [f"{n} = {v} is not in [{lo}, {hi}]" for n, v in given.items() if n in bounds and not (lo := bounds[n][0]) <= v <= (hi := bounds[n][1])]


def bounds(given: Mapping[str, tuple[float, float]]) -> list[str]:
    return [f"{n}: {lo} is not below {hi}" for n, (lo, hi) in given.items() if not lo < hi]


def correlation(c: np.ndarray, tolerance: float = 1e-8) -> list[str]:
    c = np.asarray(c, float)
    if c.ndim != 2 or c.shape[0] != c.shape[1]:
        return ["not square"]
    wrong = []
    if not np.allclose(c, c.T, atol=tolerance):
        wrong.append("not symmetric")
    if not np.allclose(np.diag(c), 1, atol=tolerance):
        wrong.append("diagonal is not one")
    if np.abs(c).max() > 1 + tolerance:
        wrong.append("out of range")
    if np.linalg.eigvalsh((c + c.T) / 2)[0] < -1e-6:
        wrong.append("not positive semidefinite")
    return wrong


def report(*frames: DataFrame) -> DataFrame:
    """All checks together."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
