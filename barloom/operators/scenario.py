"""Scenarios and stress tests. Random draws come from the counter generator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rng
from . import metrics as m


def historical(returns: DataFrame, scenarios: DataFrame) -> DataFrame:
    """(scenario, portfolio, ...) over named ranges of time. scenarios: (scenario, lo, hi, probability), a few rows, broadcast."""
    r = returns.join(F.broadcast(scenarios), F.col("ts").between(F.col("lo"), F.col("hi")))
    p = m.with_path(r, ("scenario", "portfolio"), "ts")
    cut = p.groupBy("scenario", "portfolio").agg(F.percentile("ret", F.lit(0.05)).alias("var_95"))
    c = F.col("ret")
    return p.join(cut, ["scenario", "portfolio"]).groupBy("scenario", "portfolio", "probability", "var_95").agg(
        m.total_return(c).alias("total_return"), m.volatility(c).alias("volatility"), F.min("drawdown").alias("max_drawdown"), F.avg(F.when(c <= F.col("var_95"), c)).alias("expected_shortfall"),
        F.count("*").alias("n"), F.count_if(c < 0).alias("losses"),
    )


def monte_carlo(returns: DataFrame, n_sims: int, horizon: int, method: str = "parametric", seed: int = 0) -> DataFrame:
    """(portfolio, sim, total): total returns over a horizon, of normal draws or of draws from the returns themselves."""
    size = returns.where("ret is not null").groupBy("portfolio").agg(F.avg("ret").alias("mu"), F.stddev_samp("ret").alias("sd"), F.count("*").alias("n"))
    sims = size.crossJoin(F.broadcast(returns.sparkSession.range(n_sims).withColumnRenamed("id", "sim"))).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))))
    if method == "parametric":
        drawn = sims.withColumn("r", F.col("mu") + F.col("sd") * rng.normal("sim", "t", seed))
    else:
        held = returns.where("ret is not null").select("portfolio", (F.row_number().over(Window.partitionBy("portfolio").orderBy("ts")) - 1).cast("long").alias("k"), F.col("ret").alias("r"))
        drawn = sims.withColumn("k", rng.draw("sim", "t", seed) % F.col("n")).join(held, ["portfolio", "k"])
    return drawn.groupBy("portfolio", "sim").agg(m.total_return(F.col("r")).alias("total"))


def outcomes(totals: DataFrame, value: str = "total", keys: tuple[str, ...] = ("portfolio",)) -> DataFrame:
    cut = totals.groupBy(*keys).agg(F.percentile(value, F.array(*map(F.lit, (0.05, 0.5, 0.95)))).alias("q"))
    out = totals.join(cut, list(keys))
    v = F.col(value)
    return out.groupBy(*keys, "q").agg(F.avg(v).alias("mean"), F.avg((v < 0).cast("double")).alias("p_loss"), F.avg(F.when(v <= F.col("q")[0], v)).alias("expected_shortfall")).select(
        *keys, "mean", F.col("q")[0].alias("p05"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p95"), "p_loss", "expected_shortfall"
    )


def stress_paths(returns: DataFrame, n_sims: int, shock: float, duration: int, recovery: int, correlation: float = 0.7, seed: int = 0) -> DataFrame:
    """(portfolio, sim, total, max_drawdown): returns drawn anew and scaled by a draw from [correlation, 1], plus the shock spread over its duration, then a recovery of half of it."""
    held = returns.where("ret is not null").select("portfolio", (F.row_number().over(Window.partitionBy("portfolio").orderBy("ts")) - 1).cast("long").alias("k"), "ret")
    size = held.groupBy("portfolio").agg(F.count("*").alias("n"))
    sims = size.crossJoin(F.broadcast(returns.sparkSession.range(n_sims).withColumnRenamed("id", "sim"))).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(duration + recovery - 1))))
    sims = sims.withColumns({"k": rng.draw("sim", "t", seed) % F.col("n"), "scale": rng.uniform("sim", "t", seed + 1) * (1 - correlation) + correlation})
    pushed = F.when(F.col("t") < duration, F.lit(shock / duration)).otherwise(F.lit(-shock / 2 / recovery))
    path = sims.join(held, ["portfolio", "k"]).select("portfolio", "sim", "t", (F.col("ret") * F.col("scale") + pushed).alias("ret"))
    return m.with_path(path, ("portfolio", "sim"), "t").groupBy("portfolio", "sim").agg(m.total_return(F.col("ret")).alias("total"), F.min("drawdown").alias("max_drawdown"))


def what_if(weights: DataFrame, changes: DataFrame) -> DataFrame:
    """(scenario, portfolio, symbol, w): weights with changes (scenario, symbol, change) added, set to sum to one again."""
    names = changes.select("scenario").distinct()
    all_ = weights.crossJoin(F.broadcast(names)).join(changes, ["scenario", "symbol"], "left")
    all_ = all_.withColumn("_w", F.greatest(F.col("w") + F.coalesce("change", F.lit(0.0)), F.lit(0.0)))
    return all_.select("scenario", "portfolio", "symbol", (F.col("_w") / F.nullif(F.sum("_w").over(Window.partitionBy("scenario", "portfolio")), F.lit(0.0))).alias("w"))


def factor_shocks(returns: DataFrame, shocks: DataFrame, share: float = 0.3, seed: int = 0) -> DataFrame:
    """(scenario, portfolio, total, volatility, corr): on a drawn share of bars, (return + market) x vol. shocks: (scenario, market, vol)."""
    r = returns.where("ret is not null").withColumn("t", F.row_number().over(Window.partitionBy("portfolio").orderBy("ts")))
    r = r.crossJoin(F.broadcast(shocks))
    hit = rng.uniform("t", F.lit(0), seed) < share
    r = r.withColumn("shocked", F.when(hit, (F.col("ret") + F.col("market")) * F.col("vol")).otherwise(F.col("ret")))
    c = F.col("shocked")
    return r.groupBy("scenario", "portfolio").agg(m.total_return(c).alias("total"), m.volatility(c).alias("volatility"), F.corr("ret", c).alias("corr"))


def normal_stress(returns: DataFrame, shocks: DataFrame, draws: int = 1000, seed: int = 0) -> DataFrame:
    """(scenario, portfolio, var, es) of normal draws with the mean moved and the deviation scaled. shocks: (scenario, mean_shift, vol_scale)."""
    size = returns.where("ret is not null").groupBy("portfolio").agg(F.avg("ret").alias("mu"), F.stddev_pop("ret").alias("sd"))
    d = size.crossJoin(F.broadcast(shocks)).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    d = d.withColumn("x", F.col("mu") + F.col("mean_shift") + F.col("sd") * F.col("vol_scale") * rng.normal("k", F.lit(0), seed))
    out = outcomes(d, "x", ("scenario", "portfolio"))
    return out.select("scenario", "portfolio", F.col("p05").alias("var_95"), "expected_shortfall")


def path_rules(returns: DataFrame, seed: int = 0) -> DataFrame:
    """(rule, portfolio, total, volatility) of a return path under four rules: one crash, doubled moves, a slow drift down, and rare large falls."""
    r = returns.where("ret is not null").withColumns({"t": F.row_number().over(Window.partitionBy("portfolio").orderBy("ts")), "n": F.count("*").over(Window.partitionBy("portfolio"))})
    x, t, n = F.col("ret"), F.col("t"), F.col("n")
    rules: dict[str, Column] = {
        "crash": F.when(t == F.floor(n / 2), F.lit(-0.2)).otherwise(x),
        "volatility_spike": F.when((t > F.floor(n / 3)) & (t <= F.floor(n / 3) + 20), x * 2).otherwise(x),
        "drift": x - 0.001,
        "black_swan": F.when(rng.uniform("t", F.lit(1), seed) < 0.01, x - 0.05).otherwise(x),
    }
    long = r.select("portfolio", F.explode(F.map_from_arrays(F.array(*map(F.lit, rules)), F.array(*rules.values()))).alias("rule", "ret"))
    return long.groupBy("rule", "portfolio").agg(m.total_return(F.col("ret")).alias("total"), m.volatility(F.col("ret")).alias("volatility"))
