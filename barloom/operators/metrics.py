"""Return series to scalars. Columns are aggregates over `ret`; what needs the path takes equity and drawdown columns made first."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import partial
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import windows as win

INF = float("inf")


def _div(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b, F.lit(0.0))


def total_return(r: Column) -> Column:
    return F.product(r + 1) - 1


def annual_return(r: Column, periods: float = 252) -> Column:
    """(1 + total) ^ (periods / n) - 1; null after a loss of everything."""
    growth = total_return(r) + 1
    return F.when(growth > 0, F.pow(growth, F.lit(float(periods)) / F.count(r)) - 1)


def cagr(r: Column, periods: float = 365) -> Column:
    growth = total_return(r) + 1
    years = F.greatest(F.count(r) / F.lit(float(periods)), F.lit(1e-6))
    return F.when(growth > 0, F.pow(growth, F.lit(1.0) / years) - 1)


def volatility(r: Column, periods: float = 252) -> Column:
    return F.stddev_samp(r) * math.sqrt(periods)


def sharpe(r: Column, periods: float = 252, rf: float = 0.0, population: bool = False) -> Column:
    sd = F.stddev_pop(r) if population else F.stddev_samp(r)
    return _div(F.avg(r) - rf / periods, sd) * math.sqrt(periods)


def sortino(r: Column, periods: float = 252, rf: float = 0.0) -> Column:
    """Mean excess over the sample deviation of the negative returns."""
    return _div(F.avg(r) - rf / periods, F.stddev_samp(F.when(r < 0, r))) * math.sqrt(periods)


def sortino_downside(r: Column, periods: float = 365) -> Column:
    """Annual mean over the root of the mean squared shortfall."""
    down = F.sqrt(F.avg(F.pow(F.least(r, F.lit(0.0)), F.lit(2.0))))
    return _div(F.avg(r) * periods, down * math.sqrt(periods))


def downside_deviation(r: Column, threshold: float = 0.0, periods: float = 252) -> Column:
    return F.stddev_samp(F.when(r < threshold, r)) * math.sqrt(periods)


def value_at_risk(r: Column, level: float) -> Column:
    return F.percentile(r, F.lit(1 - level))


def parametric_var(r: Column, level: float) -> Column:
    return F.avg(r) + F.stddev_pop(r) * NormalDist().inv_cdf(1 - level)


def omega(r: Column, threshold: float = 0.0) -> Column:
    up, down = F.sum(F.greatest(r - threshold, F.lit(0.0))), F.sum(F.greatest(F.lit(threshold) - r, F.lit(0.0)))
    return F.when(down == 0, F.when(up > 0, INF).otherwise(1.0)).otherwise(_div(up, down))


def gain_to_pain(r: Column) -> Column:
    up, down = F.sum(F.when(r > 0, r)), F.sum(F.when(r < 0, -r))
    return _div(up, down)


def tail_ratio(r: Column, percent: float = 0.05) -> Column:
    lo, hi = F.percentile(r, F.lit(percent)), F.percentile(r, F.lit(1 - percent))
    return F.when(lo == 0, 0.0).otherwise(F.abs(_div(hi, lo)))


def skewness_corrected(r: Column) -> Column:
    n = F.count(r)
    return F.when(n > 2, F.skewness(r) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0)))


def kurtosis_corrected(r: Column) -> Column:
    n = F.count(r).cast("double")
    return F.when(n > 3, (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * F.kurtosis(r) + 6))


def profit_factor(r: Column) -> Column:
    up, down = F.coalesce(F.sum(F.when(r > 0, r)), F.lit(0.0)), F.coalesce(F.sum(F.when(r < 0, -r)), F.lit(0.0))
    return F.when(down == 0, F.when(up > 0, INF).otherwise(0.0)).otherwise(_div(up, down))


def win_rate(r: Column) -> Column:
    return F.avg((r > 0).cast("double"))


def with_path(returns: DataFrame, keys: Sequence[str] = win.KEYS, order: str = win.ORDER) -> DataFrame:
    """equity (from 1), drawdown: what metrics of the path need. Rows without a return are left out."""
    w = win.ordered(tuple(keys), order)
    out = returns.where(F.col("ret").isNotNull()).withColumn("equity", F.product(F.col("ret") + 1).over(win.upto(w)))
    peak = F.max("equity").over(win.upto(w))
    return out.withColumn("drawdown", _div(F.col("equity"), peak) - 1)


def performance(returns: DataFrame, keys: Sequence[str] = win.KEYS, order: str = win.ORDER, periods: float = 252, rf: float = 0.02) -> DataFrame:
    """The basic bundle: one row for each series."""
    r, dd = F.col("ret"), F.col("drawdown")
    out = with_path(returns, keys, order).groupBy(*keys).agg(
        total_return(r).alias("total_return"),
        annual_return(r, periods).alias("annual_return"),
        volatility(r, periods).alias("volatility"),
        sharpe(r, periods, rf).alias("sharpe"),
        sortino(r, periods, rf).alias("sortino"),
        F.min(dd).alias("max_drawdown"),
        win_rate(r).alias("win_rate"),
        profit_factor(r).alias("profit_factor"),
        F.count(r).alias("n"),
    )
    return out.withColumn("calmar", F.coalesce(_div(F.col("annual_return"), F.abs("max_drawdown")), F.lit(0.0)))


def simulation_metrics(paths: DataFrame, keys: Sequence[str] = ("sim_id",), order: str = "t", periods: float = 365) -> DataFrame:
    """The fifteen metrics of simulated paths, one row each. A path of one partition is one group, so paths are dealt by key once."""
    r, dd = F.col("ret"), F.col("drawdown")
    base = with_path(paths, keys, order).groupBy(*keys).agg(
        total_return(r).alias("cumulative_return"),
        cagr(r, periods).alias("cagr"),
        volatility(r, periods).alias("volatility"),
        sharpe(r, periods).alias("sharpe"),
        sortino_downside(r, periods).alias("sortino"),
        F.min(dd).alias("max_drawdown"),
        F.sqrt(F.avg(dd * dd)).alias("ulcer_index"),
        F.skewness(r).alias("skewness"),
        F.kurtosis(r).alias("kurtosis"),
        F.percentile(r, F.array(F.lit(0.05), F.lit(0.01))).alias("_var"),
        omega(r).alias("omega"),
        F.collect_list(r).alias("_r"),
    )
    base = base.withColumns({"var_95": F.col("_var")[0], "var_99": F.col("_var")[1]})
    for level in ("95", "99"):
        cut = F.col(f"var_{level}")
        tail = F.filter("_r", lambda x: x <= cut)  # noqa: B023  used at once
        base = base.withColumn(f"cvar_{level}", F.aggregate(tail, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(tail), F.lit(0)))
    return base.withColumn("calmar", _div(F.col("cagr"), F.abs("max_drawdown"))).drop("_var", "_r")


def tail_mean(returns: DataFrame, levels: Sequence[float], keys: Sequence[str] = win.KEYS) -> DataFrame:
    """(keys, level, var, cvar): the quantile of each level and the mean of what lies at or below it, keyed by the level itself."""
    cuts = returns.groupBy(*keys).agg(F.percentile("ret", F.array(*[F.lit(1 - x) for x in levels])).alias("q"))
    cuts = cuts.select(*keys, F.posexplode("q").alias("k", "var")).withColumn("level", F.element_at(F.array(*map(F.lit, levels)), F.col("k") + 1))
    below = returns.join(cuts.drop("k"), list(keys)).where(F.col("ret") <= F.col("var"))
    return below.groupBy(*keys, "level").agg(F.first("var").alias("var"), F.avg("ret").alias("cvar"))


def hill_index(returns: DataFrame, keys: Sequence[str] = win.KEYS, share: float = 0.1, least: int = 10) -> DataFrame:
    """The Hill estimate from the k worst losses, k = max(least, share of n); null where one of them is no loss."""
    w = win.Window.partitionBy(*keys)
    r = returns.where("ret is not null").withColumns({"_k": F.row_number().over(w.orderBy("ret")), "_n": F.count("*").over(w)})
    k = F.greatest(F.floor(F.col("_n") * share), F.lit(least))
    worst = r.withColumns({"_top": k, "_loss": -F.col("ret")}).where("_k <= _top")
    worst = worst.withColumn("_kth", F.last("_loss").over(w.orderBy("_k").rowsBetween(win.Window.unboundedPreceding, win.Window.unboundedFollowing)))
    safe = F.when((F.col("_loss") > 0) & (F.col("_kth") > 0), F.log(F.col("_loss") / F.col("_kth")))
    return worst.groupBy(*keys).agg(
        F.when(F.min("_loss") > 0, F.lit(1.0) / F.nullif(F.avg(F.when(F.col("_k") < F.col("_top"), safe)), F.lit(0.0))).alias("tail_index"), F.max("_top").cast("long").alias("k")
    )


def relative(pairs: DataFrame, keys: Sequence[str], periods: float = 252, rf: float = 0.02) -> DataFrame:
    """beta, alpha, tracking error and information ratio of ret against bench. beta is the sample covariance over the population variance."""
    r, b = F.col("ret"), F.col("bench")
    beta = _div(F.covar_samp(r, b), F.var_pop(b))
    out = pairs.groupBy(*keys).agg(
        beta.alias("beta"), annual_return(r, periods).alias("_ar"), annual_return(b, periods).alias("_br"),
        (F.stddev_samp(r - b) * math.sqrt(periods)).alias("tracking_error"), _div(F.avg(r - b), F.stddev_samp(r - b)).alias("_ir"),
    )
    alpha = F.col("_ar") - (F.lit(rf) + F.col("beta") * (F.col("_br") - rf))
    return out.withColumns({"alpha": alpha, "information_ratio": F.col("_ir") * math.sqrt(periods)}).drop("_ar", "_br", "_ir")


#: Symbols of a block of the covariance matrix, and the most that a matrix may have.
GRAM_BLOCK, GRAM_SYMBOLS = 1024, 20_000
_MOMENTS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def _gram(frames: Iterator[pd.DataFrame], block: int) -> Iterator[pd.DataFrame]:
    """Moments of all pairs of symbols of a pair of blocks over the times read: rows (i, j, n, sx, ...). Rows: (bi, bj, x, y), arrays of (k, ret)."""
    held: dict[tuple[int, int], np.ndarray] = {}

    def matrix(vectors: pd.Series) -> np.ndarray:
        out = np.full((len(vectors), block), np.nan)
        for row, vector in enumerate(vectors):
            for cell in vector:
                out[row, cell["k"] % block] = cell["ret"]
        return out

    for frame in frames:
        for key, part in frame.groupby(["bi", "bj"]):
            for at in range(0, len(part), 512):
                rows = part.iloc[at : at + 512]
                x, y = matrix(rows["x"]), matrix(rows["y"])
                a, b = ~np.isnan(x), ~np.isnan(y)
                x, y, a, b = np.where(a, x, 0.0), np.where(b, y, 0.0), a.astype(float), b.astype(float)
                sums = np.stack([a.T @ b, x.T @ b, a.T @ y, (x * x).T @ b, a.T @ (y * y), x.T @ y])
                held[key] = held[key] + sums if key in held else sums
    for (bi, bj), sums in held.items():
        i, j = np.nonzero(sums[0])
        i, j = (i, j) if bi < bj else (i[i <= j], j[i <= j])
        yield pd.DataFrame({"i": i + bi * block, "j": j + bj * block} | {name: sums[k][i, j] for k, name in enumerate(_MOMENTS)})


def covariance(returns: DataFrame, periods: float = 252, block: int = GRAM_BLOCK) -> DataFrame:
    """(i, j, cov, corr) of all pairs of symbols with i <= j that share a time, from returns aligned on ts.

    Each time becomes one vector; tasks sum the products of whole vectors, a pair of blocks of symbols at a time, so that no pair of
    rows is ever made. A task holds six matrices of block x block. A symbol that has a time twice counts with its lowest return. More than
    GRAM_SYMBOLS symbols are refused.
    """
    spark = returns.sparkSession
    names = sorted(r.symbol for r in returns.select("symbol").where("symbol is not null").distinct().limit(GRAM_SYMBOLS + 1).collect())
    if len(names) > GRAM_SYMBOLS:
        raise ValueError(f"a covariance matrix of more than {GRAM_SYMBOLS} symbols")
    numbered = spark.createDataFrame(list(enumerate(names)), "k int, symbol string")
    block = min(block, max(1, len(names)))
    own = returns.where("ret is not null").groupBy("ts", "symbol").agg(F.min("ret").alias("ret")).join(F.broadcast(numbered), "symbol")
    vectors = own.groupBy("ts", F.floor(F.col("k") / block).cast("int").alias("b")).agg(F.collect_list(F.struct("k", "ret")).alias("v"))
    if len(names) <= block:
        pairs = vectors.select(F.col("b").alias("bi"), F.col("b").alias("bj"), F.col("v").alias("x"), F.col("v").alias("y"))
    else:  # few blocks: a time meets itself once for each pair of them
        other = vectors.select("ts", F.col("b").alias("bj"), F.col("v").alias("y"))
        pairs = vectors.select("ts", F.col("b").alias("bi"), F.col("v").alias("x")).join(other, "ts").where("bi <= bj").repartition("bi", "bj")
    sums = pairs.select("bi", "bj", "x", "y").mapInPandas(partial(_gram, block=block), "i int, j int, " + ", ".join(f"{c} double" for c in _MOMENTS))
    sums = sums.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in _MOMENTS])
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    both, vx, vy = F.col("sxy") - sx * sy / n, F.col("sxx") - sx * sx / n, F.col("syy") - sy * sy / n
    enough = F.nullif(n - 1, F.lit(0.0))
    spread = F.when((vx > 0) & (vy > 0), F.sqrt(F.when(vx > 0, vx)) * F.sqrt(F.when(vy > 0, vy)))
    name = lambda c: F.broadcast(numbered.select(F.col("k").alias(c), F.col("symbol").alias(f"_{c}")))
    out = sums.join(name("i"), "i").join(name("j"), "j")
    return out.select(F.col("_i").alias("i"), F.col("_j").alias("j"), (both / enough * periods).alias("cov"), F.when(n > 1, both / spread).alias("corr"))


def compound(returns: DataFrame, unit: str, keys: Sequence[str] = win.KEYS) -> DataFrame:
    """Returns compounded to calendar units: (keys, period, ret, n)."""
    return returns.where("ret is not null").groupBy(*keys, F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("period")).agg(
        total_return(F.col("ret")).alias("ret"), F.count("*").alias("n")
    )
