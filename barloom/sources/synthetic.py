"""Synthetic bars from the counter generator: the same numbers on any cluster, and in SQL."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rng

#: name: start price, yearly volatility, yearly drift, seed.
PRESETS = {"spy_sample": (300.0, 0.18, 0.08, 42), "volatile_stock": (50.0, 0.45, 0.12, 123), "stable_stock": (80.0, 0.12, 0.06, 456), "crypto_like": (20000.0, 0.8, 0.15, 789)}


def geometric_bars(spark: SparkSession, symbol: str, n: int, start: str = "2020-01-01", price: float = 100.0, volatility: float = 0.2, drift: float = 0.08, regimes: bool = True, seed: int = 42) -> DataFrame:
    """n daily bars of a geometric random walk. With regimes, four quarters alternate between calm rises and volatile slow ones.

    Volume rises with the size of the move. The running sum of returns is one window over the series.
    """
    dt = 1 / 252
    t = F.col("t")
    bull = (F.floor(t * 4 / n) % 2 == 0) if regimes else F.lit(None).cast("boolean")
    vol = F.when(bull, volatility * 0.8).when(~bull, volatility * 1.3).otherwise(volatility)
    mu = F.when(bull, drift * 1.5).when(~bull, drift * 0.3).otherwise(drift)
    base = spark.range(n).select(F.lit(symbol).alias("symbol"), F.col("id").alias("t"))
    base = base.withColumn("r", (mu - vol * vol / 2) * dt + vol * math.sqrt(dt) * rng.normal(t, F.lit(1), seed))
    w = Window.partitionBy("symbol").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    base = base.withColumn("close", F.exp(F.sum("r").over(w)) * price)
    base = base.withColumn("open", F.coalesce(F.lag("close").over(Window.partitionBy("symbol").orderBy("t")), F.lit(price)))
    wick = lambda k: F.abs(rng.normal(t, F.lit(k), seed)) * volatility * math.sqrt(dt) / 2
    return base.select(
        "symbol",
        (F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(t.cast("int"))).alias("ts"),
        "open",
        (F.greatest("open", "close") * (F.lit(1.0) + wick(2))).alias("high"),
        (F.least("open", "close") * (F.lit(1.0) - F.least(wick(3), F.lit(0.9)))).alias("low"),
        "close",
        F.floor((F.abs("r") * 20 + 1) * (rng.uniform(t, F.lit(4), seed) + 0.5) * 1_000_000).cast("double").alias("volume"),
    )


def preset(spark: SparkSession, name: str, n: int = 500) -> DataFrame:
    price, volatility, drift, seed = PRESETS[name]
    return geometric_bars(spark, name, n, price=price, volatility=volatility, drift=drift, seed=seed)


def _pull(bars: pd.DataFrame) -> pd.DataFrame:
    """After every 30th bar the next ten are pulled a tenth of the way to the mean so far; later bars see what was pulled."""
    bars = bars.sort_values("ts", ignore_index=True)
    x = bars[["open", "high", "low", "close"]].to_numpy(copy=True)
    for at in range(30, len(x), 30):
        mean = x[:at, 3].mean()
        for i in range(at, min(at + 10, len(x))):
            x[i] *= 1 + 0.1 * (mean - x[i, 3]) / x[i, 3]
    return bars.assign(**{c: x[:, k] for k, c in enumerate(("open", "high", "low", "close"))})


def mean_reverting(spark: SparkSession, n: int = 500, seed: int = 7) -> DataFrame:
    bars = geometric_bars(spark, "mean_reverting", n, volatility=0.2, drift=0.0, regimes=False, seed=seed)
    return bars.groupBy("symbol").applyInPandas(_pull, bars.schema)


def benchmarks(spark: SparkSession, n: int = 500) -> DataFrame:
    """Five series: a trend, a volatile one, a calm one, a flat one, and one that reverts to its mean."""
    kinds = {"trending": (0.15, 0.25), "volatile": (0.5, 0.1), "low_volatility": (0.08, 0.05), "sideways": (0.2, 0.0)}
    out = mean_reverting(spark, n)
    for k, (name, (vol, drift)) in enumerate(kinds.items()):
        out = out.unionByName(geometric_bars(spark, name, n, volatility=vol, drift=drift, regimes=False, seed=100 + k))
    return out


def multi_asset_returns(spark: SparkSession, n_assets: int, n: int, correlation: float = 0.3, seed: int = 5) -> DataFrame:
    """(t, symbol, ret) of assets with one correlation between all of them, by the Cholesky factor of the correlation matrix."""
    corr = np.full((n_assets, n_assets), correlation) + (1 - correlation) * np.eye(n_assets)
    factor = np.linalg.cholesky(corr)
    rows = [(i, j, float(factor[i, j])) for i in range(n_assets) for j in range(i + 1)]
    held = spark.createDataFrame(rows, "i int, j int, l double")
    z = spark.range(n).withColumnRenamed("id", "t").crossJoin(F.broadcast(spark.range(n_assets).select(F.col("id").cast("int").alias("j"))))
    z = z.withColumn("z", rng.normal("t", "j", seed)).join(F.broadcast(held), "j")
    share = lambda lo, hi: F.col("i") / max(1, n_assets - 1) * (hi - lo) + lo
    out = z.groupBy("t", "i").agg(F.sum(F.col("l") * F.col("z")).alias("x"))
    return out.select("t", F.concat(F.lit("Asset_"), F.col("i") + 1).alias("symbol"), (share(0.05, 0.15) / 252 + share(0.15, 0.40) / math.sqrt(252) * F.col("x")).alias("ret"))
