"""Whole analyses, put together from metrics, tests and scenarios: one long table for each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rng
from ..functions import windows as win
from . import metrics as m
from . import resample as rs
from . import scenario as sc
from . import tests as ts

#: Shifts of the mean and factors of the deviation that a risk report is stressed with; fixed values.
STRESSES = (("market_crash", -0.1, 2.0), ("high_volatility", 0.0, 1.5), ("deflation", -0.05, 1.2))


def all_metrics(returns: DataFrame, trade_metrics: DataFrame, benchmark: DataFrame | None = None, keys: Sequence[str] = win.KEYS, periods: float = 252, rf: float = 0.02) -> DataFrame:
    """Performance, trades and risk of each series in one row; with a benchmark (ts, bench) what is relative to it, too.

    win_rate is that of the trades, hit_ratio that of the returns.
    """
    keys = list(keys)
    c, dd = F.col("ret"), F.col("drawdown")
    basic = m.performance(returns, keys, win.ORDER, periods, rf).withColumnsRenamed({"win_rate": "hit_ratio", "profit_factor": "return_profit_factor"})
    path = m.with_path(returns, keys)
    risk = path.groupBy(*keys).agg(
        F.skewness(c).alias("skewness"), F.kurtosis(c).alias("kurtosis"), m.tail_ratio(c).alias("tail_ratio"), m.downside_deviation(c, 0.0, periods).alias("downside_deviation"),
        F.sqrt(F.avg(dd * dd)).alias("ulcer_index"), F.avg(dd).alias("pain_index"),
    )
    out = basic.join(risk, keys).join(tails(path, "ret", keys), keys, "left").join(trade_metrics, keys, "left")
    if benchmark is not None:
        out = out.join(m.relative(returns.join(benchmark, "ts"), keys, periods, rf), keys, "left")
    return out


def tails(values: DataFrame, value: str, keys: Sequence[str], levels: Sequence[float] = (0.95, 0.99)) -> DataFrame:
    """(keys, var_95, cvar_95, ...): a row for each group."""
    found = m.tail_mean(values.withColumn("ret", F.col(value)), levels, keys)
    at = lambda level, what: F.max(F.when(F.abs(F.col("level") - level) < 1e-9, F.col(what)))
    return found.groupBy(*keys).agg(*[at(level, what).alias(f"{what}_{round(level * 100)}") for level in levels for what in ("var", "cvar")])


def long_form(wide: DataFrame, keys: Sequence[str], name: str = "metric", value: str = "value") -> DataFrame:
    columns = [c for c in wide.columns if c not in keys]
    return wide.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(keys), columns, name, value)


def risk_report(returns: DataFrame, keys: Sequence[str] = ("portfolio",), draws: int = 10_000, seed: int = 0, periods: float = 252) -> DataFrame:
    """(keys, metric, value): tails, drawdown, deviations, ratios, and the tails under three stresses."""
    c = F.col("ret")
    path = m.with_path(returns, keys)
    plain = path.groupBy(*keys).agg(
        F.min("drawdown").alias("max_drawdown"), (F.stddev_pop(c) * periods**0.5).alias("volatility"), m.downside_deviation(c, 0.0, periods).alias("downside_deviation"), m.tail_ratio(c).alias("tail_ratio"),
        m.sharpe(c, periods).alias("sharpe"), m.sortino(c, periods).alias("sortino"), m.omega(c).alias("omega"), m.parametric_var(c, 0.95).alias("parametric_var_95"),
    )
    shocks = returns.sparkSession.createDataFrame(list(STRESSES), "scenario string, mean_shift double, vol_scale double")
    stress = long_form(sc.normal_stress(returns, shocks, draws, seed), ["scenario", *keys]).withColumn("metric", F.concat("scenario", F.lit("_"), "metric")).drop("scenario")
    return long_form(plain.join(tails(path, "ret", keys), list(keys)), keys).unionByName(stress)


def monte_carlo_var(returns: DataFrame, levels: Sequence[float] = (0.95, 0.99), draws: int = 10_000, seed: int = 0, keys: Sequence[str] = ("portfolio",)) -> DataFrame:
    """(keys, level, var): the quantiles of normal draws with the mean and the deviation of each series."""
    size = returns.where("ret is not null").groupBy(*keys).agg(F.avg("ret").alias("mu"), F.stddev_pop("ret").alias("sd"))
    drawn = size.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("x", F.col("mu") + F.col("sd") * rng.normal("k", F.lit(0), seed))
    cuts = drawn.groupBy(*keys).agg(F.percentile("x", F.array(*[F.lit(1 - x) for x in levels])).alias("q"))
    return cuts.select(*keys, F.posexplode("q").alias("k", "var")).select(*keys, F.element_at(F.array(*map(F.lit, levels)), F.col("k") + 1).alias("level"), "var")


def simulated_risk(stats: DataFrame, metrics: Sequence[str] = ("total_return", "max_drawdown", "sharpe"), ratio_of: str = "sharpe", keys: Sequence[str] = ("series",)) -> DataFrame:
    """(keys, metric, stat, value): VaR and CVaR over simulated metrics, tail and omega ratio over one of them."""
    long = stats.select(*keys, *metrics).unpivot(list(keys), list(metrics), "metric", "x").where("x is not null")
    cut = long_form(tails(long, "x", [*keys, "metric"]), [*keys, "metric"], "stat")
    c = F.col("x")
    ratios = long.where(F.col("metric") == ratio_of).groupBy(*keys, "metric").agg(m.tail_ratio(c).alias("tail_ratio"), m.omega(c).alias("omega"))
    return cut.unionByName(long_form(ratios, [*keys, "metric"], "stat"))


def with_original(stats: DataFrame, own: DataFrame) -> DataFrame:
    """Simulated metrics with a row for the series itself; label is the path's number, or Original."""
    return stats.withColumn("label", F.col("sim").cast("string")).drop("sim").unionByName(own.drop("sim").withColumn("label", F.lit("Original")))


def corrected_p_values(stats: DataFrame, own: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("series",)) -> DataFrame:
    """(keys, metric, p_two_sided, bonferroni, bh, by): where the series lies among its simulations, for each metric, corrected over a series' metrics."""
    p = ts.empirical_p(stats, own, metrics, keys).select(*keys, "metric", "p_two_sided")
    return ts.adjust(p, "p_two_sided", keys, ["metric"])


def all_tests(series: DataFrame, stats: DataFrame, own: DataFrame, metrics: Sequence[str], flips: int = 10_000, seed: int = 0) -> DataFrame:
    """(series, test, subject, statistic, p_value) of the whole suite.

    Over the simulated metrics: the series' place among them (with both corrections), Jarque-Bera, and normality by Kolmogorov-Smirnov and Anderson-Darling;
    over the returns: autocorrelation, ARCH and the permutation of signs. Kernels run one metric or series to a task.
    """
    row = lambda df, test, subject, statistic, p: df.select("series", F.lit(test).alias("test"), subject.alias("subject"), statistic.cast("double").alias("statistic"), p.alias("p_value"))
    none = F.lit(None).cast("double")
    p = corrected_p_values(stats, own, metrics)
    out = [row(p, test, F.col("metric"), none, F.col(c)) for test, c in (("empirical", "p_two_sided"), ("empirical_bonferroni", "bonferroni"), ("empirical_bh", "bh"))]
    long = stats.unpivot(["series", "sim"], list(metrics), "metric", "ret").where("ret is not null")
    out.append(row(ts.jarque_bera(long, "ret", ("series", "metric")), "jarque_bera", F.col("metric"), F.col("statistic"), F.col("p_value")))
    joint = long.select(F.concat_ws("\x00", "series", "metric").alias("series"), F.col("sim").alias("t"), "ret")
    kernels = ts.kernel_tests(joint, ["ks_normal", "anderson_darling", "mann_whitney_zero"]).withColumn("metric", F.split_part("series", F.lit("\x00"), F.lit(2))).withColumn("series", F.split_part("series", F.lit("\x00"), F.lit(1)))
    out.append(kernels.select("series", "test", F.col("metric").alias("subject"), "statistic", "p_value"))
    out.append(row(ts.kernel_tests(series, ["arch_lm"]), "arch_lm", F.lit("returns"), F.col("statistic"), F.col("p_value")))
    out.append(row(ts.autocorrelation(series), "ljung_box", F.concat(F.lit("lag "), F.col("lag").cast("string")), F.col("ljung_box"), F.col("p_value")))
    signs = rs.sign_permutation(series, flips, seed)
    out.append(row(signs, "sign_permutation", F.lit("returns"), F.col("positive"), F.col("p_two_sided")))
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def full_analysis(intervals: DataFrame, tests: DataFrame | None, risk: DataFrame, distances: Sequence[tuple[str, DataFrame, str]]) -> DataFrame:
    """(series, section, name, stat, value) of a simulation: its intervals, tests, risk over the simulated metrics, and mean and deviation of distances (name, frame, column)."""
    shape = lambda df, section, name: df.select("series", F.lit(section).alias("section"), name.alias("name"), "stat", "value")
    parts = [shape(long_form(intervals, ["series", "metric"], "stat"), "simulation", F.col("metric")), shape(risk, "risk", F.col("metric"))]
    for name, frame, column in distances:
        d = frame.groupBy("series").agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"), F.min(column).alias("least"), F.max(column).alias("most"))
        parts.append(shape(long_form(d, ["series"], "stat"), "distance", F.lit(name)))
    if tests is not None:
        t = tests.select("series", F.concat_ws(" ", "test", "subject").alias("name"), "statistic", "p_value").unpivot(["series", "name"], ["statistic", "p_value"], "stat", "value").where("value is not null")
        parts.append(shape(t, "test", F.col("name")))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _steps(value: Column, steps: Sequence[tuple[float, int]]) -> Column:
    """The points of the first bound that the value is above."""
    out = F.lit(0)
    for bound, points in reversed(steps):
        out = F.when(value > bound, points).otherwise(out)
    return out


#: Points of the edge score of 100, by the bounds that a figure must be above (a drawdown's depth: below); fixed values.
EDGE = {"sharpe": ((2.0, 15), (1.0, 10), (0.5, 5)), "total_return": ((0.5, 10), (0.2, 7), (0.0, 3)), "win_rate": ((0.6, 10), (0.55, 7), (0.5, 3))}


def edge_score_100(row: DataFrame) -> DataFrame:
    """edge_score of 100 and its band, from sharpe, total_return, win_rate, max_drawdown, is_significant, ci_lower, sim_mean and num_trades."""
    depth = F.abs("max_drawdown")
    score = sum((_steps(F.col(c), steps) for c, steps in EDGE.items()), F.lit(0))
    score += F.when(depth < 0.1, 5).when(depth < 0.2, 3).when(depth < 0.3, 1).otherwise(0)
    score += F.when(F.col("is_significant"), 25).otherwise(0)
    score += F.when(F.col("ci_lower") > 0, 20).when(F.col("sim_mean") > 0, 10).otherwise(0)
    score += F.when(F.col("num_trades") >= 50, 5).when(F.col("num_trades") >= 20, 2).otherwise(0)
    s = F.col("edge_score")
    return row.withColumn("edge_score", F.least(score, F.lit(100)).cast("int")).withColumn("band", F.when(s >= 80, "strong").when(s >= 60, "moderate").when(s >= 40, "weak").otherwise("none"))


def factor_monte_carlo(returns: DataFrame, portfolios: DataFrame, n_sims: int, horizon: int, seed: int = 0) -> DataFrame:
    """(portfolio, sim, total) of a one-factor model: the portfolio's line on the mean of all symbols, with normal draws of that mean and of the residual."""
    market = returns.where("ret is not null").groupBy("ts").agg(F.avg("ret").alias("x"))
    both = portfolios.where("ret is not null").join(market, "ts").select("portfolio", F.col("ret").alias("y"), "x")
    line = both.groupBy("portfolio").agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"), F.avg("x").alias("mu"), F.stddev_samp("x").alias("sd"))
    # The deviation of the residuals follows from the moments, so the rows are read once.
    rest = both.groupBy("portfolio").agg(F.sqrt(F.greatest(F.var_samp("y") - F.pow(F.covar_samp("x", "y"), F.lit(2.0)) / F.nullif(F.var_samp("x"), F.lit(0.0)), F.lit(0.0))).alias("noise"))
    sims = line.join(rest, "portfolio").withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(n_sims - 1)))).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))))
    drawn = F.col("a") + F.col("b") * (F.col("mu") + F.col("sd") * rng.normal("sim", "t", seed)) + F.col("noise") * rng.normal("sim", "t", seed + 1)
    return sims.withColumn("r", drawn).groupBy("portfolio", "sim").agg(m.total_return(F.col("r")).alias("total"))
