"""Portfolios. Covariances are aggregates; the number of assets is small, so what is solved for them is solved on the driver."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import metrics as m


#: The most assets whose matrix is solved on the driver.
ASSETS = 2000


def matrix(cov: DataFrame, value: str = "cov", most: int = ASSETS) -> tuple[list[str], np.ndarray]:
    """Names and the full matrix from (i, j, value) with i <= j; no more than `most` assets."""
    entries = most * (most + 1) // 2
    rows = cov.select("i", "j", value).limit(entries + 1).collect()
    if len(rows) > entries:
        raise ValueError(f"a matrix of more than {most} assets")
    names = sorted({r.i for r in rows} | {r.j for r in rows})
    at = {n: k for k, n in enumerate(names)}
    out = np.zeros((len(names), len(names)))
    for i, j, v in rows:
        out[at[i], at[j]] = out[at[j], at[i]] = v
    return names, out


def means(returns: DataFrame, names: list[str], periods: float = 252) -> np.ndarray:
    found = {r.symbol: r.mu for r in returns.where(F.col("symbol").isin(names)).groupBy("symbol").agg((F.avg("ret") * periods).alias("mu")).collect()}
    return np.array([found[n] for n in names])


def project(w: np.ndarray, most: float) -> np.ndarray:
    """The nearest weights between 0 and `most` that add up to one, by bisection on the shift."""
    if most * len(w) < 1:
        raise ValueError("the cap is too low for weights that add up to one")
    lo, hi = w.min() - most, w.max()
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if np.clip(w - mid, 0, most).sum() > 1 else (lo, mid)
    return np.clip(w - (lo + hi) / 2, 0, most)


def quadratic(cov: np.ndarray, gain: np.ndarray, most: float = 1.0, steps: int = 5000) -> np.ndarray:
    """Weights that minimise w'Cw/2 - gain'w on the capped simplex, by accelerated projected gradients."""
    n = len(cov)
    w = y = project(np.full(n, 1 / n), most)
    rate, t = 1 / max(1e-12, np.linalg.eigvalsh(cov)[-1]), 1.0
    for _ in range(steps):
        new = project(y - rate * (cov @ y - gain), most)
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - w)
        done = np.abs(new - w).max() < 1e-13
        w, t = new, t2
        if done:
            break
    return w


def minimum_variance(cov: np.ndarray, most: float = 1.0) -> np.ndarray:
    return quadratic(cov, np.zeros(len(cov)), most)


def frontier(cov: np.ndarray, mu: np.ndarray, points: int = 100, most: float = 1.0) -> list[tuple[float, np.ndarray]]:
    """(risk tolerance, weights) from the least variance to the most return."""
    scale = max(1e-12, float(np.abs(np.diag(cov)).max() / max(1e-12, np.abs(mu).max())))
    return [(lam, quadratic(cov, lam * mu, most)) for lam in np.concatenate([[0], np.geomspace(1e-3, 1e3, points - 1)]) * scale]


def target_return(cov: np.ndarray, mu: np.ndarray, target: float, most: float = 1.0) -> np.ndarray:
    """Least variance at a return of at least target, by bisection on the tolerance."""
    lo, hi = 0.0, 1e6 * max(1e-12, float(np.diag(cov).max() / max(1e-12, np.abs(mu).max())))
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if quadratic(cov, mid * mu, most, 1000) @ mu >= target else (mid, hi)
    return quadratic(cov, hi * mu, most)


def maximum_sharpe(cov: np.ndarray, mu: np.ndarray, rf: float = 0.02, most: float = 1.0) -> np.ndarray:
    """The best ratio of excess return to risk along the frontier, refined around the best point."""
    excess = mu - rf
    score = lambda w: float((w @ excess) / math.sqrt(max(1e-18, w @ cov @ w)))
    points = frontier(cov, excess, 60, most)
    k = max(range(len(points)), key=lambda i: score(points[i][1]))
    lo, hi = points[max(0, k - 1)][0], points[min(len(points) - 1, k + 1)][0]
    return max((quadratic(cov, lam * excess, most) for lam in np.linspace(lo, hi, 200)), key=score)


def risk_budget(cov: np.ndarray, budget: np.ndarray, steps: int = 10_000) -> np.ndarray:
    """Weights whose shares of the risk are the budget, by cyclic coordinate descent on the log-barrier problem."""
    x = 1 / np.sqrt(np.diag(cov))
    for _ in range(steps):
        before = x.copy()
        for i in range(len(x)):
            rest = cov[i] @ x - cov[i, i] * x[i]
            x[i] = (-rest + math.sqrt(rest * rest + 4 * cov[i, i] * budget[i])) / (2 * cov[i, i])
        if np.abs(x - before).max() < 1e-14 * np.abs(x).max():
            break
    return x / x.sum()


def risk_parity(cov: np.ndarray) -> np.ndarray:
    return risk_budget(cov, np.full(len(cov), 1 / len(cov)))


def maximum_diversification(cov: np.ndarray) -> np.ndarray:
    """Least variance of the correlations, each weight then divided by its volatility."""
    s = np.sqrt(np.diag(cov))
    w = minimum_variance(cov / np.outer(s, s)) / s
    return w / w.sum()


def black_litterman(cov: np.ndarray, market: np.ndarray, picks: np.ndarray, views: np.ndarray, aversion: float = 2.5, tau: float = 1.0, confidence: float = 0.5) -> np.ndarray:
    """Posterior mean returns. The views' uncertainty is confidence x P C P': a higher value trusts them less."""
    prior = aversion * cov @ market
    omega = np.diag(np.diag(confidence * picks @ cov @ picks.T))
    a, b = np.linalg.inv(tau * cov), picks.T @ np.linalg.inv(omega)
    return np.linalg.solve(a + b @ picks, a @ prior + b @ views)


def ward_order(points: np.ndarray) -> list[int]:
    """The leaves of a Ward tree over the rows of points, from left to right: a merged group keeps the smaller of its numbers, ties go to the smallest pair.

    Distances by inner products, and one matrix that each merge updates in place: n^2 numbers, n^2 steps a merge in NumPy.
    """
    own = np.square(points).sum(axis=1)
    dist = np.sqrt(np.maximum(own[:, None] + own[None, :] - 2 * points @ points.T, 0.0))
    dist[np.tril_indices(len(dist))] = np.inf
    groups = {i: [i] for i in range(len(dist))}
    size = np.ones(len(dist))
    while len(groups) > 1:
        i, j = divmod(int(np.argmin(dist)), len(dist))
        rest = np.array([k for k in groups if k not in (i, j)], int)
        if len(rest):
            at = lambda x: (np.minimum(x, rest), np.maximum(x, rest))  # noqa: B023, E731
            a, b, c, n = dist[at(i)], dist[at(j)], dist[i, j], size[rest]
            dist[at(i)] = np.sqrt(((size[i] + n) * a * a + (size[j] + n) * b * b - n * c * c) / (size[i] + size[j] + n))
        dist[j, :] = dist[:, j] = np.inf
        size[i] += size[j]
        groups[i] += groups.pop(j)
    return next(iter(groups.values()))


def hierarchical_risk_parity(cov: np.ndarray) -> np.ndarray:
    """Assets are put in the order of a Ward tree over their correlation distances; risk is then split top down between halves."""
    s = np.sqrt(np.diag(cov))
    d = np.sqrt(np.clip(0.5 * (1 - cov / np.outer(s, s)), 0, 1))
    order = ward_order(d)
    w = np.ones(len(cov))

    def variance(items: list[int]) -> float:
        part = cov[np.ix_(items, items)]
        inverse = 1 / np.diag(part)
        inverse /= inverse.sum()
        return float(inverse @ part @ inverse)

    stack = [order]
    while stack:
        items = stack.pop()
        if len(items) > 1:
            a, b = items[: len(items) // 2], items[len(items) // 2 :]
            share = 1 - variance(a) / (variance(a) + variance(b))
            w[a] *= share
            w[b] *= 1 - share
            stack += [a, b]
    return w


def kelly(cov: np.ndarray, mu: np.ndarray, leverage: float = 1.0) -> np.ndarray:
    """Inverse covariance times means, scaled to the leverage; equal weights where there is none."""
    try:
        w = np.linalg.solve(cov, mu)
    except np.linalg.LinAlgError:
        w = np.zeros(len(mu))
    total = np.abs(w).sum()
    return w / total * leverage if total > 0 else np.full(len(mu), leverage / len(mu))


def weights_frame(spark: SparkSession, names: list[str], solved: dict[str, np.ndarray]) -> DataFrame:
    return spark.createDataFrame([(k, n, float(x)) for k, w in solved.items() for n, x in zip(names, w)], "portfolio string, symbol string, w double")


def portfolio_returns(returns: DataFrame, weights: DataFrame, keys: tuple[str, ...] = ("portfolio",)) -> DataFrame:
    """(keys, ts, ret): the weighted sum of what each time has. Whether the weights are broadcast is left to their size."""
    both = returns.where("ret is not null").join(weights, "symbol")
    return both.groupBy(*keys, "ts").agg(F.sum(F.col("ret") * F.col("w")).alias("ret"))


def portfolio_metrics(returns: DataFrame, weights: DataFrame, periods: float = 252, rf: float = 0.02) -> DataFrame:
    return m.performance(portfolio_returns(returns, weights), ("portfolio",), "ts", periods, rf)


def diversification_ratio(cov: DataFrame, weights: DataFrame) -> DataFrame:
    """(portfolio, ratio): weighted volatilities over the volatility of the whole."""
    w = weights.select("portfolio", "symbol", "w")
    pairs = cov.join(w.select("portfolio", F.col("symbol").alias("i"), F.col("w").alias("wi")), "i")
    pairs = pairs.join(w.select("portfolio", F.col("symbol").alias("j"), F.col("w").alias("wj")), ["portfolio", "j"])
    own = F.col("i") == F.col("j")
    variance = F.sum(F.col("wi") * F.col("wj") * F.col("cov") * F.when(own, 1.0).otherwise(2.0))
    return pairs.groupBy("portfolio").agg((F.sum(F.when(own, F.col("wi") * F.sqrt("cov"))) / F.nullif(F.sqrt(variance), F.lit(0.0))).alias("ratio"))


def component_var(returns: DataFrame, weights: DataFrame, level: float = 0.95, step: float = 0.01) -> DataFrame:
    """(portfolio, symbol, component_var): by how much a slightly higher weight moves the portfolio's value at risk, times the weight.

    All raised portfolios are evaluated in one plan, as scenarios.
    """
    names = weights.select("portfolio", F.col("symbol").alias("bumped"))
    grid = weights.join(names, "portfolio").withColumn("w2", F.col("w") + F.when(F.col("symbol") == F.col("bumped"), step).otherwise(0.0))
    total = F.sum("w2").over(Window.partitionBy("portfolio", "bumped"))
    grid = grid.select("portfolio", "bumped", "symbol", (F.col("w2") / total).alias("w"))
    raised = portfolio_returns(returns, grid, ("portfolio", "bumped")).groupBy("portfolio", "bumped").agg(m.value_at_risk(F.col("ret"), level).alias("var_up"))
    base = portfolio_returns(returns, weights).groupBy("portfolio").agg(m.value_at_risk(F.col("ret"), level).alias("var"))
    out = raised.join(base, "portfolio").join(weights.withColumnRenamed("symbol", "bumped"), ["portfolio", "bumped"])
    return out.select("portfolio", F.col("bumped").alias("symbol"), ((F.col("var_up") - F.col("var")) / step * F.col("w")).alias("component_var"))


def attribution(returns: DataFrame, weights: DataFrame) -> DataFrame:
    """Brinson effects of each asset against equal weights, on summed returns."""
    per = returns.where("ret is not null").groupBy("symbol").agg(F.sum("ret").alias("r"))
    per = per.crossJoin(F.broadcast(per.agg(F.avg("r").alias("rb"), F.count("*").alias("n"))))
    both = per.join(weights, "symbol")
    wb = F.lit(1.0) / F.col("n")
    return both.select("portfolio", "symbol", ((F.col("w") - wb) * F.col("rb")).alias("allocation"), (wb * (F.col("r") - F.col("rb"))).alias("selection"), ((F.col("w") - wb) * (F.col("r") - F.col("rb"))).alias("interaction"))


def rebalancing(returns: DataFrame, weights: DataFrame, every: int, cost: float = 0.001) -> DataFrame:
    """(portfolio, ts, value) of a portfolio set back to its weights every `every` bars, less costs on what is traded.

    Within a segment the value is the weighted product of returns, so segments are evaluated apart and chained by a running product.
    Only times at which every asset of the portfolio has a return count.
    """
    held = weights.withColumn("_assets", F.count("*").over(Window.partitionBy("portfolio")))
    r = returns.where("ret is not null").join(held, "symbol")
    r = r.withColumn("_here", F.count("*").over(Window.partitionBy("portfolio", "ts"))).where("_here = _assets").drop("_here", "_assets")
    order = Window.partitionBy("portfolio", "symbol").orderBy("ts")
    r = r.withColumn("seg", F.floor((F.row_number().over(order) - 1) / every))
    inside = Window.partitionBy("portfolio", "symbol", "seg").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("g", F.product(F.col("ret") + 1).over(inside) * F.col("w"))
    v = r.groupBy("portfolio", "seg", "ts").agg(F.sum("g").alias("v"), F.collect_list(F.struct("g", "w")).alias("parts"))
    last = Window.partitionBy("portfolio", "seg").orderBy(F.desc("ts"))
    traded = F.aggregate("parts", F.lit(0.0), lambda a, p: a + F.abs(p["g"] / F.col("v") - p["w"]))
    ends = v.withColumn("_k", F.row_number().over(last)).where("_k = 1").select("portfolio", "seg", (F.col("v") * (F.lit(1.0) - traded * cost)).alias("f"))
    chain = Window.partitionBy("portfolio").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("start", F.coalesce(F.product("f").over(chain), F.lit(1.0)))
    return v.join(ends.select("portfolio", "seg", "start"), ["portfolio", "seg"]).select("portfolio", "ts", (F.col("v") * F.col("start")).alias("value"))


def turnover(old: DataFrame, new: DataFrame) -> DataFrame:
    """(portfolio, turnover): half the sum of weight changes over all assets that either has."""
    a, b = old.select("portfolio", "symbol", F.col("w").alias("w0")), new.select("portfolio", "symbol", F.col("w").alias("w1"))
    both = a.join(b, ["portfolio", "symbol"], "full_outer")
    return both.groupBy("portfolio").agg((F.sum(F.abs(F.coalesce("w1", F.lit(0.0)) - F.coalesce("w0", F.lit(0.0)))) / 2).alias("turnover"))


def rebalance_trades(positions: DataFrame, prices: DataFrame, weights: DataFrame, cost: float = 0.001, least: float = 100.0) -> DataFrame:
    """(portfolio, symbol, trade_value, trade_cost): what brings positions (units) to the weights; trades under `least` are not made.

    A position without a price counts at its entry price.
    """
    priced = positions.join(prices, "symbol", "left").withColumn("value", F.col("units") * F.coalesce("price", "entry_price"))
    total = F.sum("value").over(Window.partitionBy("portfolio"))
    both = priced.withColumn("total", total).join(weights, ["portfolio", "symbol"], "left")
    trade = F.coalesce("w", F.lit(0.0)) * F.col("total") - F.col("value")
    out = both.withColumn("_t", trade)
    return out.select("portfolio", "symbol", F.when(F.abs("_t") >= least, F.col("_t")).otherwise(0.0).alias("trade_value"), F.when(F.abs("_t") >= least, F.abs("_t") * cost).otherwise(0.0).alias("trade_cost"))
