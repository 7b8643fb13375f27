"""Whole analyses: reports, full simulations, searches over splits, and checks of what is solved."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import rng
from ..functions import windows as win
from ..operators import analysis as an
from ..operators import backtest as bt
from ..operators import indicators as ind
from ..operators import metrics as m
from ..operators import optimize as opt
from ..operators import portfolio as pf
from ..operators import resample as rs
from ..operators import scenario as sc
from ..operators import signals as sig
from ..sources import periods
from . import sql
from .q_metrics import rd
from .q_portfolio import _MCOUT, PATH, PSQL, WALK_SQL, _outcome_sql, prets, rets, walk_forward, weights
from .q_resample import _FLIPS, _METRICS, _OWN, LONG, SERIES, _stats_sql, path_stats, paths, samples, series
from .q_signals import _ALGEBRA, _EQUITY
from .q_windows import damped_hourly, daily, hourly, r, rounded
from .registry import query

_NAMES = ["2024", "2023", "ytd", "1m", "3m", "6m", "1y", "2024-01-05,2024-01-12"]
_BACK = {"1m": 30, "3m": 90, "6m": 180, "1y": 365}


def _period_sql(name: str) -> str:
    if name in _BACK:
        lo, hi = f"today - {_BACK[name]}", "today"
    elif name == "ytd":
        lo, hi = "date_trunc('year', today)::date", "today"
    elif "," in name:
        lo, hi = (f"date '{x}'" for x in name.split(","))
    else:
        lo, hi = f"date '{name}-01-01'", f"date '{name}-12-31'"
    return f"select '{name}' as period, symbol, count(*) as n, min(ts) as first_ts, max(ts) as last_ts from bars, t where ts::date between {lo} and {hi} group by 2"


@query("flt05_named_periods", sql.bars("h", "t as (select max(ts)::date as today from bars)") + " union all ".join(map(_period_sql, _NAMES)))
def _(spark, sf):
    bars = hourly(spark, sf)
    today = bars.agg(F.max("ts").alias("ts")).first().ts.date()
    out = None
    for name in _NAMES:
        part = periods.in_period(bars, name, today).groupBy("symbol").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).withColumn("period", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


_TAILS = ", ".join(f"quantile_cont({{x}}, {1 - x!r}) as v{round(x * 100)}" for x in (0.95, 0.99))


@query("agg26_all_metrics", sql.bars("x", _ALGEBRA + ", " + _EQUITY + """, bm as (select ts, avg(ret) as bench from r where ret is not null group by 1), q2 as (select symbol, ts, er as ret, product(1 + er) over (partition by symbol order by ts rows unbounded preceding) as eq from q1 where er is not null),
    q3 as (select *, eq / max(eq) over (partition by symbol order by ts rows unbounded preceding) - 1 as dd from q2), qv as (select symbol, """ + _TAILS.format(x="ret") + """ from q3 group by 1),
    tm as (select symbol, count(*) as num_trades, avg((pnl > 0)::double) as win_rate, sum(pnl) as total_pnl from tp group by 1), rl as (select symbol, covar_samp(ret, bench) / var_pop(bench) as beta, stddev_samp(ret - bench) * sqrt(252) as tracking_error from q3 join bm using (ts) group by 1)""")
    + """select symbol, round(product(1 + ret) - 1, 6) as total_return, round(stddev_samp(ret) * sqrt(252), 6) as volatility, round((avg(ret) - 0.02 / 252) / stddev_samp(ret) * sqrt(252), 6) as sharpe, round(min(dd), 6) as max_drawdown, round(avg((ret > 0)::double), 6) as hit_ratio, count(*) as n, round(max(v95), 6) as var_95, round(max(v99), 6) as var_99,
    round(avg(ret) filter (where ret <= v95), 6) as cvar_95, round(avg(ret) filter (where ret <= v99), 6) as cvar_99, round(kurtosis_pop(ret), 4) as kurtosis, round(stddev_samp(ret) filter (where ret < 0) * sqrt(252), 6) as downside_deviation, round(sqrt(avg(dd * dd)), 6) as ulcer_index, round(avg(dd), 6) as pain_index,
    max(num_trades) as num_trades, round(max(win_rate), 6) as win_rate, round(max(total_pnl), 4) as total_pnl, round(max(beta), 6) as beta, round(max(tracking_error), 6) as tracking_error from q3 join qv using (symbol) join tm using (symbol) join rl using (symbol) group by 1""")
def _(spark, sf):
    bars = ind.with_returns(damped_hourly(spark, sf))
    run = bt.event_backtest(sig.momentum(damped_hourly(spark, sf)))
    own = run.select("symbol", "ts", (F.col("equity") / F.nullif(F.lag("equity").over(win.spec()), F.lit(0.0)) - 1).alias("ret")).where("ret is not null")
    bench = bars.where("ret is not null").groupBy("ts").agg(F.avg("ret").alias("bench"))
    out = an.all_metrics(own, bt.trade_metrics(bt.trades(run)), bench)
    six = "total_return volatility sharpe max_drawdown hit_ratio var_95 var_99 cvar_95 cvar_99 downside_deviation ulcer_index pain_index win_rate beta tracking_error".split()
    return out.select("symbol", "n", "num_trades", r(F.col("total_pnl"), 4).alias("total_pnl"), r(F.col("kurtosis"), 4).alias("kurtosis"), *[r(F.col(c)).alias(c) for c in six])


_SHSQL = "sh as (select * from (values " + ", ".join(f"('{a}', {b}::double, {c}::double)" for a, b, c in an.STRESSES) + ") v(scenario, market, vol))"
_RISK = {
    "max_drawdown": "min(dd)", "volatility": "stddev_pop(ret) * sqrt(252)", "downside_deviation": "stddev_samp(ret) filter (where ret < 0) * sqrt(252)", "tail_ratio": "abs(quantile_cont(ret, 0.95) / quantile_cont(ret, 0.05))", "sharpe": "avg(ret) / stddev_samp(ret) * sqrt(252)",
    "sortino": "avg(ret) / stddev_samp(ret) filter (where ret < 0) * sqrt(252)", "omega": "sum(greatest(ret, 0)) / sum(greatest(-ret, 0))", "parametric_var_95": "avg(ret) + stddev_pop(ret) * -1.6448536269514722", "var_95": "max(v95)", "var_99": "max(v99)", "cvar_95": "avg(ret) filter (where ret <= v95)", "cvar_99": "avg(ret) filter (where ret <= v99)",
}


@query("agg31_risk_report", sql.bars("y", PATH + ", qv as (select portfolio, " + _TAILS.format(x="ret") + f""" from p group by 1), {_SHSQL}, z as (select portfolio, avg(ret) as mu, stddev_pop(ret) as sd from pr group by 1), mc as (select scenario, portfolio, mu + market + sd * vol * {rng.normal_sql('k', '0', 31)} as x from z, sh, (select unnest(range(10000)) as k)), """ + _outcome_sql("mc", "scenario, portfolio", "x")
    + ", st as (select scenario, portfolio, max(p05) as v, avg(x) filter (where x <= p05) as es from mc join oq using (scenario, portfolio) group by 1, 2)") + " union all ".join(f"select portfolio, '{k}' as metric, round({e}, 6) as value from p join qv using (portfolio) group by 1" for k, e in _RISK.items())
    + " union all select portfolio, scenario || '_var_95', round(v, 6) from st union all select portfolio, scenario || '_expected_shortfall', round(es, 6) from st")
def _(spark, sf):
    return rd(an.risk_report(prets(spark, sf), seed=31), ["portfolio", "metric"])


@query("agg11_monte_carlo_var", sql.bars("y", PSQL + f", z as (select portfolio, avg(ret) as mu, stddev_pop(ret) as sd from pr group by 1), mc as (select portfolio, mu + sd * {rng.normal_sql('k', '0', 47)} as x from z, (select unnest(range(10000)) as k))") + "select portfolio, 0.95::double as level, round(quantile_cont(x, 0.05), 6) as var from mc group by 1 union all select portfolio, 0.99::double, round(quantile_cont(x, 0.01), 6) from mc group by 1")
def _(spark, sf):
    return rd(an.monte_carlo_var(prets(spark, sf), seed=47), ["portfolio", "level"])


_SIMRISK = """sv as (select series, metric, x from st unpivot (x for metric in (total_return, max_drawdown, sharpe))), sq as (select series, metric, quantile_cont(x, 0.05) as v95, quantile_cont(x, 0.01) as v99 from sv group by 1, 2),
    sx as (select series, metric, max(v95) as var_95, max(v99) as var_99, avg(x) filter (where x <= v95) as cvar_95, avg(x) filter (where x <= v99) as cvar_99, abs(quantile_cont(x, 0.95) / quantile_cont(x, 0.05)) as tail_ratio,
        case when sum(greatest(-x, 0)) = 0 then case when sum(greatest(x, 0)) > 0 then 'infinity'::double else 1 end else sum(greatest(x, 0)) / sum(greatest(-x, 0)) end as omega from sv join sq using (series, metric) group by 1, 2),
    srisk as (select series, metric, stat, value from sx unpivot (value for stat in (var_95, var_99, cvar_95, cvar_99, tail_ratio, omega)) where metric = 'sharpe' or stat not in ('tail_ratio', 'omega'))"""


@query("agg39_simulated_risk", sql.bars("y", samples("block", LONG) + ", " + _stats_sql() + ", " + _SIMRISK) + "select series, metric, stat, round(value, 6) as value from srisk")
def _(spark, sf):
    return rd(an.simulated_risk(path_stats(paths(spark, sf, "block", LONG))), ["series", "metric", "stat"])


def own_stats(spark, sf):
    return path_stats(series(spark, sf).withColumn("sim", F.lit(0).cast("long")))


@query("set04_original_row", sql.bars("y", samples("block", LONG) + ", " + _stats_sql() + ", " + _OWN) + "".join(f"select series, label, {', '.join(f'round({c}, 6) as {c}' for c in _METRICS)} from (select *, sim::varchar as label from st union all by name select *, 'Original' as label from ow)"))
def _(spark, sf):
    return rd(an.with_original(path_stats(paths(spark, sf, "block", LONG)), own_stats(spark, sf)), ["series", "label"])


@query("viz05_percentile_of_actual", sql.bars("y", samples("block", LONG) + ", " + _stats_sql() + ", " + _OWN) + "select series, round(max(ow.sharpe), 6) as actual, round(avg((st.sharpe <= ow.sharpe + 1e-12)::double), 6) as percentile from st join ow using (series) group by 1")
def _(spark, sf):
    own = own_stats(spark, sf).select("series", F.col("sharpe").alias("own"))
    both = path_stats(paths(spark, sf, "block", LONG)).join(own, "series")
    return both.groupBy("series").agg(r(F.max("own")).alias("actual"), r(F.avg((F.col("sharpe") <= F.col("own") + 1e-12).cast("double"))).alias("percentile"))


@query("viz06_rolling_risk_return", sql.bars("h") + f"select symbol, ts, round({sql.sma('ret', 63)} * 25200, 6) as annual_return, round({sql.std('ret', 63)} * sqrt(252), 6) as volatility from r qualify {sql.sma('ret', 63)} is not null")
def _(spark, sf):
    bars = ind.with_returns(hourly(spark, sf)).withColumns({"annual_return": win.sma("ret", 63) * 25200, "volatility": win.std("ret", 63) * 252**0.5})
    return rounded(bars.where("annual_return is not null and volatility is not null"), ["symbol", "ts"], ["annual_return", "volatility"])


_BOUNDS = [(rule, name, float(lo), float(hi)) for rule, held in sig.BOUNDS.items() for name, (lo, hi) in held.items()]


@query("sig21_parameter_bounds", "select * from (values " + ", ".join(f"('{a}', '{b}', {c}::double, {d}::double)" for a, b, c, d in _BOUNDS) + ") v(rule, parameter, least, most)")
def _(spark, sf):
    return spark.createDataFrame([(rule, name, *map(float, sig.BOUNDS[rule][name])) for rule in sig.RULES for name in sig.BOUNDS[rule]], "rule string, parameter string, least double, most double")


_P2 = " union all ".join(f"select st.series, '{c}' as metric, least(1, 2 * least((count(*) filter (where st.{c} <= ow.{c} + 1e-12) + 1) / (count(*) + 1), (count(*) filter (where st.{c} >= ow.{c} - 1e-12) + 1) / (count(*) + 1))) as p from st join ow using (series) group by 1" for c in _METRICS)
_CORRECTED = f"""p2 as ({_P2}), pk as (select *, row_number() over (partition by series order by p, metric) as k, count(*) over (partition by series) as m from p2),
    pc as (select series, metric, p, least(p * m, 1) as bonferroni, least(min(p * m / k) over (partition by series order by k desc rows unbounded preceding), 1) as bh,
        least(min(p * m / k) over (partition by series order by k desc rows unbounded preceding) * sum(1.0::double / k) over (partition by series), 1) as q_by from pk)"""


@query("tst13_corrected_p_values", sql.bars("y", samples("stationary", LONG) + ", " + _stats_sql() + ", " + _OWN + ", " + _CORRECTED) + "select series, metric, round(p, 6) as p_two_sided, round(bonferroni, 6) as bonferroni, round(bh, 6) as bh, round(q_by, 6) as \"by\" from pc")
def _(spark, sf):
    return rd(an.corrected_p_values(path_stats(paths(spark, sf, "stationary", LONG)), own_stats(spark, sf), _METRICS), ["series", "metric"])


@query("tst13_all_tests")
def _(spark, sf):
    return rd(an.all_tests(series(spark, sf), path_stats(paths(spark, sf, "stationary", LONG)), own_stats(spark, sf), _METRICS, seed=11), ["series", "test", "subject"])


@query("tst17_edge_score_100", sql.bars("y", samples("block", LONG) + ", " + _FLIPS + ", " + _stats_sql() + ", " + _OWN + """, wr as (select series, avg((ret > 0)::double) as win_rate, count(*) as num_trades from s group by 1), sp as (select series, (count(*) filter (where heads >= positive) + 1) / (count(*) + 1) as p from fl group by 1),
    ci as (select series, quantile_cont(sharpe, 0.025) as lo, avg(sharpe) as mean from st group by 1)""") + """select series, (least(100, case when sharpe > 2 then 15 when sharpe > 1 then 10 when sharpe > 0.5 then 5 else 0 end + case when total_return > 0.5 then 10 when total_return > 0.2 then 7 when total_return > 0 then 3 else 0 end
    + case when win_rate > 0.6 then 10 when win_rate > 0.55 then 7 when win_rate > 0.5 then 3 else 0 end + case when abs(max_drawdown) < 0.1 then 5 when abs(max_drawdown) < 0.2 then 3 when abs(max_drawdown) < 0.3 then 1 else 0 end + case when p < 0.05 then 25 else 0 end + case when lo > 0 then 20 when mean > 0 then 10 else 0 end
    + case when num_trades >= 50 then 5 when num_trades >= 20 then 2 else 0 end))::int as edge_score, case when edge_score >= 80 then 'strong' when edge_score >= 60 then 'moderate' when edge_score >= 40 then 'weak' else 'none' end as band from ow join wr using (series) join sp using (series) join ci using (series)""")
def _(spark, sf):
    s = series(spark, sf)
    won = s.groupBy("series").agg(m.win_rate(F.col("ret")).alias("win_rate"), F.count("*").alias("num_trades"))
    flips = rs.sign_permutation(s, 10_000, 11).select("series", (F.col("p_greater") < 0.05).alias("is_significant"))
    sims = path_stats(paths(spark, sf, "block", LONG)).groupBy("series").agg(F.percentile("sharpe", F.lit(0.025)).alias("ci_lower"), F.avg("sharpe").alias("sim_mean"))
    return an.edge_score_100(own_stats(spark, sf).join(won, "series").join(flips, "series").join(sims, "series")).select("series", "edge_score", "band")


_WASS = "wa as (select series, ret as x, row_number() over (partition by series order by ret, t) as k from s), wb as (select series, sim, ret as y, row_number() over (partition by series, sim order by ret, t) as k from p), wd as (select wb.series, sim, avg(abs(x - y)) as d from wb join wa on wa.series = wb.series and wa.k = wb.k group by 1, 2)"


def _analysis(spark, sf, whole: bool):
    s = series(spark, sf)
    p = rs.shared(paths(spark, sf, "block", LONG), "paths")
    st = rs.shared(path_stats(p), "stats")
    distances = [("wasserstein", rs.wasserstein(s, p), "distance")]
    if whole:
        distances.append(("mmd", rs.mmd(s, p), "mmd"))
    tests = an.all_tests(s, st, own_stats(spark, sf), _METRICS, seed=11) if whole else None
    return rd(an.full_analysis(rs.intervals(st, _METRICS), tests, an.simulated_risk(st), distances), ["series", "section", "name", "stat"])


@query("bst08_full_simulation_1000_paths", sql.bars("y", samples("block", LONG) + ", " + _stats_sql() + ", " + _SIMRISK + ", " + _WASS) + " union all ".join(f"select series, 'simulation' as section, '{c}' as name, '{k}' as stat, round({e.format(c=c)}, 6) as value from st group by 1" for c in _METRICS for k, e in {"mean": "avg({c})", "lo": "quantile_cont({c}, 0.025)", "hi": "quantile_cont({c}, 0.975)", "p_positive": "avg(({c} > 0)::double)"}.items())
    + " union all select series, 'risk', metric, stat, round(value, 6) from srisk" + "".join(f" union all select series, 'distance', 'wasserstein', '{k}', round({e}, 6) from wd group by 1" for k, e in {"mean": "avg(d)", "std": "stddev_pop(d)", "least": "min(d)", "most": "max(d)"}.items()))
def _(spark, sf):
    """What SQL can express of the full analysis in time: simulation, risk, and the distance of ranks."""
    return _analysis(spark, sf, False)


@query("bst08_full_analysis")
def _(spark, sf):
    """All of it, with the kernel distance (quadratic in a series) and the tests."""
    return _analysis(spark, sf, True)


@query("scn02_monte_carlo_one_factor", sql.bars("y", PSQL + f""", mk as (select ts, avg(ret) as x from r where ret is not null group by 1), fl0 as (select portfolio, regr_slope(ret, x) as b, regr_intercept(ret, x) as a, avg(x) as mu, stddev_samp(x) as sd from pr join mk using (ts) group by 1), fl as (select portfolio, any_value(a) as a, any_value(b) as b, any_value(mu) as mu, any_value(sd) as sd, stddev_samp(ret - a - b * x) as noise from pr join mk using (ts) join fl0 using (portfolio) group by 1),
    mc as (select portfolio, sim, product(1 + a + b * (mu + sd * {rng.normal_sql('sim', 't', 51)}) + noise * {rng.normal_sql('sim', 't', 52)}) - 1 as total from fl, (select unnest(range(1000)) as sim), (select unnest(range(252)) as t) group by 1, 2), """ + _outcome_sql("mc")) + _MCOUT)
def _(spark, sf):
    return rd(sc.outcomes(an.factor_monte_carlo(rets(spark, sf), prets(spark, sf), 1000, 252, 51)), ["portfolio"])


@query("opt05_walk_forward_summary", sql.bars("x", WALK_SQL + ", bw as (select * from ps qualify row_number() over (partition by symbol, fold order by score desc, params_id) = 1)") + " union all ".join(f"select symbol, '{c}' as subject, round(avg({c}), 6) as mean, round(stddev_pop({c}), 6) as std, round(min({c}), 6) as least, round(max({c}), 6) as most, count(*) as folds, count(*) filter (where oos > 0) as positive_folds from bw group by 1" for c in ("lookback", "threshold", "oos")))
def _(spark, sf):
    chosen = walk_forward(spark, sf)
    return rd(opt.stability(chosen, ["lookback", "threshold", "oos"], "oos"), ["symbol", "subject", "folds", "positive_folds"])


_SOLVED = ("minimum_variance", "target_return", "target_return_mean", "risk_parity", "risk_budget", "maximum_sharpe", "maximum_diversification", "weights", "frontier", "black_litterman", "hierarchical")


@query("ptf02_03_04_05_06_optimality", "select * from (values " + ", ".join(f"('{n}', 0.0::double)" for n in _SOLVED) + ') v("check", excess)')
def _(spark, sf):
    """How far the solved weights are from the conditions of an optimum; 0 to three digits. SQL states the zeros."""
    base = rets(spark, sf)
    names, cov = pf.matrix(m.covariance(base))
    mu = pf.means(base, names)
    n = len(names)
    budget = np.arange(1, n + 1) / np.arange(1, n + 1).sum()
    mv, ms, md, rp, rb = pf.minimum_variance(cov), pf.maximum_sharpe(cov, mu, most=0.6), pf.maximum_diversification(cov), pf.risk_parity(cov), pf.risk_budget(cov, budget)
    target = float(mu.mean())
    tr = pf.target_return(cov, mu, target)

    def gap(w, gradient):
        """Where weight is held the gradient of what is minimised is as low as anywhere."""
        return float(((gradient - gradient.min()) * (w > 1e-4)).max() / abs(gradient).max())

    drawn = np.random.default_rng(0).dirichlet(np.ones(n), 20_000)
    risk = np.sqrt(np.einsum("ki,ij,kj->k", drawn, cov, drawn))
    risk_of = lambda w: float(np.sqrt(w @ cov @ w))
    share = lambda w: w * (cov @ w) / (w @ cov @ w)
    capped = drawn.max(axis=1) <= 0.6
    near = np.abs(drawn @ mu - target) < 1e-3 * abs(mu).max()
    found = {
        "minimum_variance": gap(mv, cov @ mv),
        "target_return": max(0.0, risk_of(tr) / risk[near].min() - 1.001) if near.any() else 0.0,
        "target_return_mean": max(0.0, target - float(tr @ mu)) / abs(mu).max(),
        "risk_parity": float(np.abs(share(rp) - 1 / n).max()),
        "risk_budget": float(np.abs(share(rb) - budget).max()),
        "maximum_sharpe": max(0.0, float((drawn[capped] @ mu / risk[capped]).max()) - float(ms @ mu) / risk_of(ms)),
        "maximum_diversification": max(0.0, float((drawn @ np.sqrt(np.diag(cov)) / risk).max()) - float(md @ np.sqrt(np.diag(cov))) / risk_of(md)),
        "weights": max(abs(float(w.sum()) - 1) + max(0.0, -float(w.min())) for w in (mv, ms, md, rp, rb, tr)),
    }
    points = [w for _, w in pf.frontier(cov, mu, 40)]
    means, variances = np.array([w @ mu for w in points]), np.array([w @ cov @ w for w in points])
    # Means and variances rise together, and no mixture of two neighbours of a point beats it.
    between = [np.interp(means[k], means[[k - 1, k + 1]], variances[[k - 1, k + 1]]) for k in range(1, len(points) - 1)]
    fall = max(0.0, -np.diff(means).min() / abs(mu).max(), -np.diff(variances).min() / variances.max())
    found["frontier"] = max(fall, float((variances[1:-1] - between).max()) / variances.max())
    market, pick, view = np.full(n, 1 / n), np.eye(1, n), np.array([mu.mean()])
    posterior, prior = pf.black_litterman(cov, market, pick, view), 2.5 * cov @ market
    pull = np.linalg.solve(cov, posterior - prior) + pick.T @ np.linalg.solve(np.diag(np.diag(0.5 * pick @ cov @ pick.T)), pick @ posterior - view)
    found["black_litterman"] = float(np.abs(pull).max() / np.abs(np.linalg.solve(cov, prior)).max())
    hrp, s = pf.hierarchical_risk_parity(cov), np.sqrt(np.diag(cov))
    order = pf.ward_order(np.sqrt(np.clip(0.5 * (1 - cov / np.outer(s, s)), 0, 1)))
    risks = []
    for part in (order[: n // 2], order[n // 2 :]):  # either half's weight is in proportion to the other's variance under inverse variances
        inverse = 1 / np.diag(cov)[part]
        risks.append(float(inverse @ cov[np.ix_(part, part)] @ inverse / inverse.sum() ** 2))
    found["hierarchical"] = abs(float(hrp[order[: n // 2]].sum()) - risks[1] / sum(risks))
    return spark.createDataFrame([(k, abs(round(float(v), 3))) for k, v in found.items()], "check string, excess double")


@query("opt07_composite_search")
def _(spark, sf):
    """All combinations with z_exit < z_entry over one pair of daily bars, ranked by 0.3 x the score of the first 70 % and 0.7 x that of the rest."""
    from .q_windows import pair_of

    grid = opt.grid(spark, {"window": [40, 60, 80], "z_entry": [1.5, 2.0, 2.5], "z_exit": [0.3, 0.5, 0.7], "te_window": [20, 30, 40], "risk": [0.01, 0.02, 0.03]}).where("z_exit < z_entry")
    found = opt.composite_search(pair_of(daily(spark, sf)), grid)
    return rd(found, ["params_id", "window", "z_entry", "z_exit", "te_window", "risk", "rank"])
