"""Hypothesis tests. What SQL expresses is an aggregate; what needs special functions runs one kernel for each series."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import stats


def empirical_p(simulated: DataFrame, benchmark: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("series",), same: float = 1e-12) -> DataFrame:
    """Values within `same` of the benchmark's count as equal to it, whatever order they were summed in. Where a benchmark's metrics lie among simulated ones: (keys, metric, benchmark_value, sim_mean, sim_std, rank, p_left, p_right, p_two_sided, p_mid, effect_size)."""
    long = simulated.unpivot(list(keys), list(metrics), "metric", "value").where("value is not null")
    held = benchmark.unpivot(list(keys), list(metrics), "metric", "benchmark_value")
    v, b = F.col("value"), F.col("benchmark_value")
    out = long.join(held, [*keys, "metric"]).groupBy(*keys, "metric", "benchmark_value").agg(
        F.avg(v).alias("sim_mean"), F.stddev_pop(v).alias("sim_std"), F.count_if(v <= b + same).alias("rank"), F.count_if(v < b - same).alias("_below"), F.count_if(F.abs(v - b) <= same).alias("_equal"), F.count_if(v >= b - same).alias("_above"), F.count("*").alias("_n")
    )
    left, right = (F.col("rank") + 1) / (F.col("_n") + 1), (F.col("_above") + 1) / (F.col("_n") + 1)
    mid = (F.col("_below") + F.col("_equal") * 0.5 + 0.5) / (F.col("_n") + 1)
    one = F.lit(1.0)
    out = out.withColumns({"p_left": left, "p_right": right, "p_two_sided": F.least(F.least(left, right) * 2, one), "p_mid": F.least(F.least(mid, one - mid) * 2, one)})
    return out.withColumn("effect_size", (b - F.col("sim_mean")) / F.nullif("sim_std", F.lit(0.0))).drop("_below", "_equal", "_above", "_n")


def adjust(p: DataFrame, column: str = "p_value", keys: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """p with bonferroni, bh and by: adjusted within each group of keys. A group is a family of tests, of one row for each hypothesis."""
    w = Window.partitionBy(*keys)
    m = F.count("*").over(w)
    out = p.withColumns({"_m": m, "_k": F.row_number().over(w.orderBy(column, *order))})
    out = out.withColumn("_raw", F.col(column) * F.col("_m") / F.col("_k"))
    fold = F.min("_raw").over(w.orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0))
    harmonic = F.sum(F.lit(1.0) / F.col("_k")).over(w)
    out = out.withColumns({"bonferroni": F.least(F.col(column) * F.col("_m"), F.lit(1.0)), "bh": F.least(fold, F.lit(1.0)), "by": F.least(fold * harmonic, F.lit(1.0))})
    return out.drop("_m", "_k", "_raw")


def jarque_bera(series: DataFrame, value: str = "ret", keys: Sequence[str] = ("series",)) -> DataFrame:
    s, k = F.skewness(value), F.kurtosis(value)
    jb = F.count(value) / 6.0 * (s * s + k * k / 4)
    return series.groupBy(*keys).agg(jb.alias("statistic"), F.exp(-jb / 2).alias("p_value"))


def autocorrelation(series: DataFrame, lags: int = 10) -> DataFrame:
    """(series, lag, acf, ljung_box, p_value) up to each lag. One pass: all lags of a row come from one window."""
    w = Window.partitionBy("series").orderBy("t")
    whole = Window.partitionBy("series")
    x = series.withColumn("_x", F.col("ret") - F.avg("ret").over(whole))
    x = x.withColumns({f"_l{k}": F.lag("_x", k).over(w) for k in range(1, lags + 1)})
    sums = x.groupBy("series").agg(F.count("*").alias("n"), F.sum(F.col("_x") * F.col("_x")).alias("_v"), *[F.sum(F.col("_x") * F.col(f"_l{k}")).alias(f"_c{k}") for k in range(1, lags + 1)])
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), (F.col(f"_c{k}") / F.nullif("_v", F.lit(0.0))).alias("acf")) for k in range(1, lags + 1)]))
    long = sums.select("series", "n", pairs.alias("p")).select("series", "n", "p.*")
    running = F.sum(F.col("acf") * F.col("acf") / (F.col("n") - F.col("lag"))).over(Window.partitionBy("series").orderBy("lag"))
    long = long.withColumn("ljung_box", F.col("n") * (F.col("n") + 2) * running)
    chi = _pandas_column(lambda q, k: stats.chi2_sf(q, k))
    return long.withColumn("p_value", chi(F.col("ljung_box"), F.col("lag"))).drop("n")


def _pandas_column(f: Callable[[float, int], float]) -> Callable[[Column, Column], Column]:
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(float(x), int(y)) for x, y in zip(a, b)])

    return F.pandas_udf(run, "double")


#: Tests of one sample that need a kernel: name -> function of sorted-by-time values to (statistic, p-value).
KERNELS: dict[str, Callable[..., tuple[float, float]]] = {
    "ks_normal": stats.ks_normal,
    "ks_uniform": stats.ks_uniform,
    "anderson_darling": stats.anderson_darling,
    "shapiro": stats.shapiro,
    "wilcoxon": stats.wilcoxon,
    "arch_lm": stats.arch_lm,
    "mann_whitney_zero": lambda x: stats.mann_whitney(x, [0.0]),
}


def kernel_tests(series: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """(series, test, statistic, p_value) of the tests in KERNELS, a series to a task. Anderson-Darling has a critical value in place of a p-value."""
    wanted = list(names or KERNELS)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        x = frame.sort_values("t")["ret"].to_numpy()
        rows = [(frame["series"].iloc[0], n, *KERNELS[n](x)) for n in wanted]
        return pd.DataFrame(rows, columns=["series", "test", "statistic", "p_value"])

    return series.groupBy("series").applyInPandas(run, "series string, test string, statistic double, p_value double")


def ks_two_sample(values: DataFrame, group: str, a: str, b: str, value: str = "ret", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, statistic): the largest difference of two groups' distribution functions, from running counts over the union."""
    v = values.where(F.col(group).isin(a, b) & F.col(value).isNotNull())
    at = v.groupBy(*keys, value).agg(F.count_if(F.col(group) == a).alias("_a"), F.count_if(F.col(group) == b).alias("_b"))
    w = Window.partitionBy(*keys)
    run = w.orderBy(value)
    fa, fb = F.sum("_a").over(run) / F.sum("_a").over(w), F.sum("_b").over(run) / F.sum("_b").over(w)
    return at.withColumn("_d", F.abs(fa - fb)).groupBy(*keys).agg(F.max("_d").alias("statistic"))


def mann_whitney_two_sample(values: DataFrame, group: str, a: str, b: str, value: str = "ret", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, statistic, p_value): U of group a against b by mean ranks over the union, two-sided by the normal law with ties and continuity corrected."""
    v = values.where(F.col(group).isin(a, b) & F.col(value).isNotNull())
    at = v.groupBy(*keys, value).agg(F.count_if(F.col(group) == a).alias("_a"), F.count("*").alias("_c"))
    rank = F.sum("_c").over(Window.partitionBy(*keys).orderBy(value)) - (F.col("_c") - 1) / 2
    c = F.col("_c").cast("double")
    n = at.withColumn("_r", rank).groupBy(*keys).agg(F.sum(F.col("_r") * F.col("_a")).alias("_s"), F.sum("_a").cast("double").alias("_n"), F.sum(c).alias("_all"), F.sum(c * c * c - c).alias("_ties"))
    n = n.withColumn("_m", F.col("_all") - F.col("_n")).where("_n > 0 and _m > 0")
    nm = F.col("_n") * F.col("_m")
    var = nm / 12 * (F.col("_all") + 1 - F.col("_ties") / (F.col("_all") * (F.col("_all") - 1)))
    u = F.col("_s") - F.col("_n") * (F.col("_n") + 1) / 2
    z = F.when(var > 0, (F.abs(u - nm / 2) - 0.5) / F.sqrt(F.when(var > 0, var))).otherwise(0.0)
    p = _pandas_column(lambda z, _: min(1.0, 2 * (1 - stats._N.cdf(max(0.0, z)))))
    return n.select(*keys, u.alias("statistic"), p(z, F.lit(0)).alias("p_value"))


def reality_check(performance: DataFrame, simulated: DataFrame) -> DataFrame:
    """White's check over strategies: performance (strategy, f), simulated (sim, strategy, f). One row: best, statistic and p_value."""
    joined = simulated.join(performance.select("strategy", F.col("f").alias("_f")), "strategy")
    worst = joined.groupBy("sim").agg(F.max(F.col("f") - F.col("_f")).alias("v"))
    best = performance.agg(F.max("f").alias("statistic"), F.max_by("strategy", "f").alias("best"))
    return worst.crossJoin(F.broadcast(best)).groupBy("best", "statistic").agg(F.avg((F.col("v") >= F.col("statistic")).cast("double")).alias("p_value"), F.count("*").alias("n_sims"))


def step_m(performance: DataFrame, simulated: DataFrame, alpha: float = 0.05, steps: int = 10) -> list[str]:
    """Romano-Wolf: the strategies whose performance exceeds what the best of those still undecided reaches by chance.

    The loop runs over decisions, at most `steps` of them; each is one aggregate, of which one number comes back.
    """
    rejected: list[str] = []
    for _ in range(steps):
        left = performance.where(~F.col("strategy").isin(rejected)) if rejected else performance
        joined = simulated.join(left.select("strategy", F.col("f").alias("_f")), "strategy")
        worst = joined.groupBy("sim").agg(F.max(F.col("f") - F.col("_f")).alias("v"))
        cut = worst.agg(F.percentile("v", F.lit(1 - alpha))).first()[0]
        new = [r.strategy for r in left.where(F.col("f") > F.lit(cut)).select("strategy").collect()] if cut is not None else []
        if not new:
            break
        rejected += new
    return sorted(rejected)


def edge_score(row: DataFrame) -> DataFrame:
    """score of 10 and band, from p_value, sharpe, win_rate, p_positive and max_drawdown."""
    points = {"p_value < 0.05": 3, "sharpe > 1": 2, "win_rate > 0.55": 2, "p_positive > 0.7": 2, "max_drawdown > -0.2": 1}
    score = sum((F.when(F.expr(k), v).otherwise(0) for k, v in points.items()), F.lit(0))
    out = row.withColumn("edge_score", score.cast("int"))
    s = F.col("edge_score")
    return out.withColumn("band", F.when(s >= 8, "strong").when(s >= 6, "moderate").when(s >= 4, "weak").otherwise("none"))
