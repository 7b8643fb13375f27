"""Portfolios, scenarios, parameter search and data checks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import rng
from ..functions import windows as win
from ..operators import bayes
from ..operators import indicators as ind
from ..operators import metrics as m
from ..operators import optimize as opt
from ..operators import portfolio as pf
from ..operators import scenario as sc
from ..operators import signals as sig
from ..operators import validate as val
from . import sql
from .q_metrics import rd
from .q_signals import lagged
from .q_windows import damped_hourly, damped_weekly, hourly, r, rounded, weekly
from ..sources.shared import written
from .registry import query

WEIGHTS = {"equal": {"A": 1 / 3, "N": 1 / 3, "R": 1 / 3}, "tilted": {"A": 0.5, "N": 0.3, "R": 0.2}}
_ROWS = [(p, s, w) for p, ws in WEIGHTS.items() for s, w in ws.items()]
WSQL = "wt as (select * from (values " + ", ".join(f"('{p}', '{s}', {w!r}::double)" for p, s, w in _ROWS) + ") v(portfolio, symbol, w))"
PSQL = WSQL + ", pr as (select portfolio, ts, sum(ret * w) as ret from r join wt using (symbol) where ret is not null group by 1, 2)"
PATH = PSQL + """, p0 as (select *, product(1 + ret) over (partition by portfolio order by ts rows unbounded preceding) as equity from pr), p as (select *, equity / max(equity) over (partition by portfolio order by ts rows unbounded preceding) - 1 as dd from p0)"""


def weights(spark):
    return spark.createDataFrame(_ROWS, "portfolio string, symbol string, w double")


def rets(spark, sf):
    return ind.with_returns(damped_weekly(spark, sf))


def prets(spark, sf):
    return pf.portfolio_returns(rets(spark, sf), weights(spark))


@query("joi04_portfolio_returns", sql.bars("y", PSQL) + "select portfolio, ts, round(ret, 8) as ret from pr")
def _(spark, sf):
    return rounded(prets(spark, sf), ["portfolio", "ts"], ["ret"], 8)


@query("ptf01_portfolio_metrics", sql.bars("y", PATH) + "select portfolio, round(product(1 + ret) - 1, 6) as total_return, round(stddev_samp(ret) * sqrt(252), 6) as volatility, round((avg(ret) - 0.02 / 252) / stddev_samp(ret) * sqrt(252), 6) as sharpe, round(min(dd), 6) as max_drawdown, count(*) as n from p group by 1")
def _(spark, sf):
    return rd(pf.portfolio_metrics(rets(spark, sf), weights(spark)).select("portfolio", "total_return", "volatility", "sharpe", "max_drawdown", "n"), ["portfolio", "n"])


_COV = "cv as (select a.symbol as i, b.symbol as j, covar_samp(a.ret, b.ret) * 252 as cov from r a join r b using (ts) where a.ret is not null and b.ret is not null group by 1, 2)"


@query("ptf02_03_04_05_06_11_12_14_optimised_weights")
def _(spark, sf):
    base = rets(spark, sf)
    names, cov = pf.matrix(m.covariance(base))
    mu = pf.means(base, names)
    n = len(names)
    equal = np.full(n, 1 / n)
    solved = {
        "minimum_variance": pf.minimum_variance(cov), "maximum_sharpe_capped": pf.maximum_sharpe(cov, mu, most=0.4), "target_return": pf.target_return(cov, mu, float(mu.mean())), "risk_parity": pf.risk_parity(cov),
        "risk_budget": pf.risk_budget(cov, np.arange(1, n + 1) / np.arange(1, n + 1).sum()), "maximum_diversification": pf.maximum_diversification(cov), "hierarchical": pf.hierarchical_risk_parity(cov),
        "kelly": pf.kelly(cov, mu), "black_litterman": pf.maximum_sharpe(cov, pf.black_litterman(cov, equal, np.eye(1, n), np.array([mu.mean()]))),
    }
    return rd(pf.weights_frame(spark, names, solved), ["portfolio", "symbol"])


@query("ptf02_minimum_variance_two_assets", sql.bars("y", "c as (select (select var_samp(ret) from r where symbol = 'A') as va, (select var_samp(ret) from r where symbol = 'N') as vb, covar_samp(a.ret, b.ret) as k from r a join r b using (ts) where a.symbol = 'A' and b.symbol = 'N' and a.ret is not null and b.ret is not null), w as (select greatest(0, least(1, (vb - k) / (va + vb - 2 * k))) as w from c)") + "select 'A' as symbol, round(w, 5) as w from w union all select 'N', round(1 - w, 5) from w")
def _(spark, sf):
    names, cov = pf.matrix(m.covariance(rets(spark, sf).where(F.col("symbol").isin("A", "N"))))
    return pf.weights_frame(spark, names, {"x": pf.minimum_variance(cov)}).select("symbol", r(F.col("w"), 5).alias("w"))


_THREE = _COV + """, mn as (select symbol, avg(ret) * 252 as mu from r where ret is not null group by 1),
    c as (select max(cov) filter (where i = 'A' and j = 'A') as aa, max(cov) filter (where i = 'A' and j = 'N') as an, max(cov) filter (where i = 'A' and j = 'R') as ar, max(cov) filter (where i = 'N' and j = 'N') as nn, max(cov) filter (where i = 'N' and j = 'R') as nr, max(cov) filter (where i = 'R' and j = 'R') as rr,
        (select mu from mn where symbol = 'A') as ma, (select mu from mn where symbol = 'N') as mn_, (select mu from mn where symbol = 'R') as mr from cv),
    k as (select ma * (nn * rr - nr * nr) - an * (mn_ * rr - nr * mr) + ar * (mn_ * nr - nn * mr) as xa, aa * (mn_ * rr - nr * mr) - ma * (an * rr - nr * ar) + ar * (an * mr - mn_ * ar) as xn, aa * (nn * mr - mn_ * nr) - an * (an * mr - mn_ * ar) + ma * (an * nr - nn * ar) as xr,
        sign(aa * (nn * rr - nr * nr) - an * (an * rr - nr * ar) + ar * (an * nr - nn * ar)) as det from c),
    b as (select *, 2.5 / 3 * (aa + an + ar) as pa, 2.5 / 3 * (an + nn + nr) as pn, 2.5 / 3 * (ar + nr + rr) as pr_, (ma + mn_ + mr) / 3 as view from c),
    h as (select *, aa as v1, (1 / nn + 1 / rr + 2 * nr / (nn * rr)) / pow(1 / nn + 1 / rr, 2) as v2 from c), w as (select v2 / (v1 + v2) as wa, v1 / (v1 + v2) * rr / (nn + rr) as wn, v1 / (v1 + v2) * nn / (nn + rr) as wr from h)"""
_VALUES = {
    "kelly": ("k", ("det * xa / (abs(xa) + abs(xn) + abs(xr))", "det * xn / (abs(xa) + abs(xn) + abs(xr))", "det * xr / (abs(xa) + abs(xn) + abs(xr))")),
    "black_litterman_mean": ("b", ("pa + aa / (1.5 * aa) * (view - pa)", "pn + an / (1.5 * aa) * (view - pa)", "pr_ + ar / (1.5 * aa) * (view - pa)")),
    "hierarchical": ("w", ("wa", "wn", "wr")),
}


@query("ptf04_06_11_closed_forms", sql.bars("y", _THREE) + " union all ".join(f"select '{k}' as portfolio, '{s}' as symbol, round({e}, 5) + 0.0 as w from {source}" for k, (source, es) in _VALUES.items() for s, e in zip("ANR", es)))
def _(spark, sf):
    """Three assets, for which SQL can write the inverse, the posterior and the bisection out."""
    base = rets(spark, sf)
    names, cov = pf.matrix(m.covariance(base))
    mu = pf.means(base, names)
    solved = {"kelly": pf.kelly(cov, mu), "black_litterman_mean": pf.black_litterman(cov, np.full(3, 1 / 3), np.eye(1, 3), np.array([mu.mean()])), "hierarchical": pf.hierarchical_risk_parity(cov)}
    return rd(pf.weights_frame(spark, names, solved), ["portfolio", "symbol"], 5)


@query("ptf03_efficient_frontier")
def _(spark, sf):
    base = rets(spark, sf)
    names, cov = pf.matrix(m.covariance(base))
    mu = pf.means(base, names)
    rows = [(k, float(w @ mu), float(np.sqrt(w @ cov @ w))) for k, (_, w) in enumerate(pf.frontier(cov, mu, 100))]
    return rd(spark.createDataFrame(rows, "point int, mean double, volatility double"), ["point"])


@query("ptf07_brinson_attribution", sql.bars("y", WSQL + ", a as (select symbol, sum(ret) as x from r where ret is not null group by 1), b as (select avg(x) as rb, count(*) as n from a)") + "select portfolio, symbol, round((w - 1.0::double / n) * rb, 6) + 0.0 as allocation, round(1.0::double / n * (x - rb), 6) + 0.0 as selection, round((w - 1.0::double / n) * (x - rb), 6) + 0.0 as interaction from a join wt using (symbol), b")
def _(spark, sf):
    return rd(pf.attribution(rets(spark, sf), weights(spark)), ["portfolio", "symbol"])


@query("ptf08_rebalancing", sql.bars("y", WSQL + """, a0 as (select portfolio, symbol, ts, w, ret from r join wt using (symbol) where ret is not null qualify count(*) over (partition by portfolio, ts) = 3), a as (select portfolio, symbol, ts, w, ret, floor((row_number() over (partition by portfolio, symbol order by ts) - 1) / 21) as seg from a0), g as (select *, w * product(1 + ret) over (partition by portfolio, symbol, seg order by ts rows unbounded preceding) as g from a),
    v as (select portfolio, seg, ts, sum(g) as v from g group by 1, 2, 3), x as (select g.portfolio, g.seg, g.ts, max(v) * (1 - 0.001 * sum(abs(g / v - w))) as f from g join v on v.portfolio = g.portfolio and v.ts = g.ts group by 1, 2, 3), e as (select portfolio, seg, arg_max(f, ts) as f from x group by 1, 2), c as (select *, coalesce(product(f) over (partition by portfolio order by seg rows between unbounded preceding and 1 preceding), 1) as start from e)""")
    + "select portfolio, ts, round(v * start, 8) as value from v join c using (portfolio, seg)")
def _(spark, sf):
    return rounded(pf.rebalancing(rets(spark, sf), weights(spark), 21), ["portfolio", "ts"], ["value"], 8)


_DRIFT = "dw as (select portfolio, symbol, w * product(1 + ret) as g from r join wt using (symbol) where ret is not null group by portfolio, symbol, w), dn as (select portfolio, symbol, g / sum(g) over (partition by portfolio) as w from dw where symbol <> 'R')"


@query("ptf09_joi06_turnover", sql.bars("y", WSQL + ", " + _DRIFT) + "select portfolio, round(sum(abs(coalesce(dn.w, 0) - wt.w)) / 2, 6) as turnover from wt left join dn using (portfolio, symbol) group by 1")
def _(spark, sf):
    """From weights to those that the returns have made of them, with one symbol sold."""
    w = weights(spark)
    grown = rets(spark, sf).where("ret is not null").groupBy("symbol").agg(F.product(F.col("ret") + 1).alias("g"))
    new = w.join(grown, "symbol").where("symbol <> 'R'").select("portfolio", "symbol", (F.col("w") * F.col("g")).alias("g"))
    new = new.select("portfolio", "symbol", (F.col("g") / F.sum("g").over(win.Window.partitionBy("portfolio"))).alias("w"))
    return rd(pf.turnover(w, new), ["portfolio"])


_POS = "ps as (select l_returnflag as symbol, sum(l_quantity) as units, avg(l_extendedprice / l_quantity) as entry_price from lineitem group by 1), px as (select symbol, arg_max(close, ts) as price from r where symbol <> 'R' group by 1)"


@query("ptf10_joi07_rebalance_trades", sql.bars("w", WSQL + ", " + _POS + ", v as (select portfolio, symbol, w, units * coalesce(price, entry_price) as value from ps join wt using (symbol) left join px using (symbol)), t as (select *, w * sum(value) over (partition by portfolio) - value as tv from v)") + "select portfolio, symbol, round(case when abs(tv) >= 100 then tv else 0 end, 2) as trade_value, round(case when abs(tv) >= 100 then abs(tv) * 0.001 else 0 end, 4) as trade_cost from t")
def _(spark, sf):
    from ..sources.bars import table

    li = table(spark, sf, "lineitem")
    held = li.groupBy(F.col("l_returnflag").alias("symbol")).agg(F.sum("l_quantity").alias("units"), F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("entry_price"))
    w = weights(spark)
    positions = held.crossJoin(F.broadcast(w.select("portfolio").distinct()))
    prices = weekly(spark, sf).where("symbol <> 'R'").groupBy("symbol").agg(F.max_by("close", "ts").alias("price"))
    out = pf.rebalance_trades(positions, prices, w)
    return out.select("portfolio", "symbol", r(F.col("trade_value"), 2).alias("trade_value"), r(F.col("trade_cost"), 4).alias("trade_cost"))


@query("ptf13_diversification_ratio", sql.bars("y", WSQL + ", " + _COV + ", q as (select a.portfolio, sum(a.w * b.w * cov) as var, sum(case when i = j then a.w * sqrt(cov) else 0 end) as s from cv join wt a on a.symbol = i join wt b on b.symbol = j and a.portfolio = b.portfolio group by 1)") + "select portfolio, round(s / sqrt(var), 6) as ratio from q")
def _(spark, sf):
    return rd(pf.diversification_ratio(m.covariance(rets(spark, sf)), weights(spark)), ["portfolio"])


@query("agg37_component_var", sql.bars("y", PSQL + """, n as (select a.portfolio, b.symbol as bumped, a.symbol, a.w + (a.symbol = b.symbol)::int * 0.01::double as w from wt a join wt b using (portfolio)), nn as (select portfolio, bumped, symbol, w / sum(w) over (partition by portfolio, bumped) as w from n),
    up as (select portfolio, bumped, ts, sum(ret * w) as ret from r join nn using (symbol) where ret is not null group by 1, 2, 3), uv as (select portfolio, bumped, quantile_cont(ret, 0.05) as u from up group by 1, 2), bv as (select portfolio, quantile_cont(ret, 0.05) as b from pr group by 1)""")
    + "select uv.portfolio, bumped as symbol, round((u - b) / 0.01::double * w, 6) as component_var from uv join bv using (portfolio) join wt on wt.portfolio = uv.portfolio and wt.symbol = bumped")
def _(spark, sf):
    return rd(pf.component_var(rets(spark, sf), weights(spark)), ["portfolio", "symbol"])


_SCN = [("early", "1995-06-01", "1996-06-01", 0.2), ("middle", "1997-01-01", "1998-12-31", 0.5), ("late", "2000-01-01", "2001-12-31", 0.3)]


@query("scn01_srt05_historical_scenarios", sql.bars("y", PSQL + ", sc as (select * from (values " + ", ".join(f"('{n}', timestamp '{a}', timestamp '{b}', {p}::double)" for n, a, b, p in _SCN) + """) v(scenario, lo, hi, probability)), x as (select scenario, portfolio, probability, ts, ret from pr join sc on ts between lo and hi), y0 as (select *, product(1 + ret) over w as eq from x window w as (partition by scenario, portfolio order by ts rows unbounded preceding)),
    y1 as (select *, eq / max(eq) over (partition by scenario, portfolio order by ts rows unbounded preceding) - 1 as dd from y0), q as (select scenario, portfolio, quantile_cont(ret, 0.05) as v from x group by 1, 2)""")
    + "select scenario, portfolio, probability, round(max(v), 6) as var_95, round(product(1 + ret) - 1, 6) as total_return, round(stddev_samp(ret) * sqrt(252), 6) as volatility, round(min(dd), 6) as max_drawdown, round(avg(ret) filter (where ret <= v), 6) as expected_shortfall, count(*) as n, count(*) filter (where ret < 0) as losses from y1 join q using (scenario, portfolio) group by 1, 2, 3")
def _(spark, sf):
    s = spark.createDataFrame(_SCN, "scenario string, a string, b string, probability double").select("scenario", F.col("a").cast("timestamp_ntz").alias("lo"), F.col("b").cast("timestamp_ntz").alias("hi"), "probability")
    return rd(sc.historical(prets(spark, sf), s), ["scenario", "portfolio", "probability", "n", "losses"]).orderBy(F.desc("probability"), "portfolio")


def _outcome_sql(source: str, keys: str = "portfolio", value: str = "total") -> str:
    return f"""oq as (select {keys}, quantile_cont({value}, 0.05) as p05, quantile_cont({value}, 0.5) as p50, quantile_cont({value}, 0.95) as p95 from {source} group by all)"""


_MCOUT = "select portfolio, round(avg(total), 6) as mean, round(max(p05), 6) as p05, round(max(p50), 6) as p50, round(max(p95), 6) as p95, round(avg((total < 0)::double), 6) as p_loss, round(avg(total) filter (where total <= p05), 6) as expected_shortfall from mc join oq using (portfolio) group by 1"
_SIZE = "z as (select portfolio, avg(ret) as mu, stddev_samp(ret) as sd, count(*) as n from pr group by 1), sg as (select portfolio, mu, sd, n, sim, t from z, (select unnest(range(10000)) as sim), (select unnest(range(252)) as t))"


@query("scn02_monte_carlo_parametric", sql.bars("y", PSQL + ", " + _SIZE + f", mc as (select portfolio, sim, product(1 + mu + sd * {rng.normal_sql('sim', 't', 19)}) - 1 as total from sg group by 1, 2), " + _outcome_sql("mc")) + _MCOUT)
def _(spark, sf):
    return rd(sc.outcomes(sc.monte_carlo(prets(spark, sf), 10_000, 252, "parametric", 19)), ["portfolio"])


@query("scn02_monte_carlo_bootstrap", sql.bars("y", PSQL + ", " + _SIZE + f", hk as (select portfolio, row_number() over (partition by portfolio order by ts) - 1 as k, ret from pr), mc as (select sg.portfolio, sim, product(1 + ret) - 1 as total from (select *, {rng.draw_sql('sim', 't', 19)} % n as k from sg) sg join hk on hk.portfolio = sg.portfolio and hk.k = sg.k group by 1, 2), " + _outcome_sql("mc")) + _MCOUT)
def _(spark, sf):
    return rd(sc.outcomes(sc.monte_carlo(prets(spark, sf), 10_000, 252, "bootstrap", 19)), ["portfolio"])


@query("scn03_stress_paths", sql.bars("y", PSQL + f""", z as (select portfolio, count(*) as n from pr group by 1), hk as (select portfolio, row_number() over (partition by portfolio order by ts) - 1 as k, ret from pr), sg as (select portfolio, sim, t, {rng.draw_sql('sim', 't', 23)} % n as k, {rng.uniform_sql('sim', 't', 24)} * (1 - 0.7::double) + 0.7::double as scale from z, (select unnest(range(1000)) as sim), (select unnest(range(30)) as t)),
    pa as (select sg.portfolio, sim, t, ret * scale + case when t < 10 then -0.3::double / 10 else 0.3::double / 2 / 20 end as ret from sg join hk on hk.portfolio = sg.portfolio and hk.k = sg.k), pb as (select *, product(1 + ret) over (partition by portfolio, sim order by t rows unbounded preceding) as eq from pa), pc as (select *, eq / max(eq) over (partition by portfolio, sim order by t rows unbounded preceding) - 1 as dd from pb)""")
    + "select portfolio, sim, round(product(1 + ret) - 1, 6) as total, round(min(dd), 6) as max_drawdown from pc group by 1, 2")
def _(spark, sf):
    return rd(sc.stress_paths(prets(spark, sf), 1000, -0.3, 10, 20, 0.7, 23), ["portfolio", "sim"])


_CHANGES = [("more_a", "A", 0.1), ("no_n", "N", -1.0), ("more_r", "R", 0.25)]


@query("scn04_what_if", sql.bars("y", WSQL + ", ch as (select * from (values " + ", ".join(f"('{a}', '{b}', {c}::double)" for a, b, c in _CHANGES) + """) v(scenario, symbol, change)), sn as (select distinct scenario from ch), nw as (select sn.scenario, portfolio, wt.symbol, greatest(w + coalesce(change, 0), 0) as w from wt cross join sn left join ch on ch.scenario = sn.scenario and ch.symbol = wt.symbol), nn as (select scenario, portfolio, symbol, w / sum(w) over (partition by scenario, portfolio) as w from nw),
    pr as (select scenario, portfolio, ts, sum(ret * w) as ret from r join nn using (symbol) where ret is not null group by 1, 2, 3)""")
    + "select scenario, portfolio, round(avg(ret) * 252, 6) as mean, round(stddev_samp(ret) * sqrt(252), 6) as volatility from pr group by 1, 2")
def _(spark, sf):
    changes = spark.createDataFrame(_CHANGES, "scenario string, symbol string, change double")
    p = pf.portfolio_returns(rets(spark, sf), sc.what_if(weights(spark), changes), ("scenario", "portfolio"))
    return p.groupBy("scenario", "portfolio").agg(r(F.avg("ret") * 252).alias("mean"), r(m.volatility(F.col("ret"))).alias("volatility"))


_SHOCKS = [("crash", -0.02, 1.5), ("calm", 0.0, 0.5)]
_SHSQL = "sh as (select * from (values " + ", ".join(f"('{a}', {b}::double, {c}::double)" for a, b, c in _SHOCKS) + ") v(scenario, market, vol))"


@query("scn05_factor_shocks", sql.bars("y", PSQL + f", {_SHSQL}, t as (select *, row_number() over (partition by portfolio order by ts) as k from pr), x as (select scenario, portfolio, ret, case when {rng.uniform_sql('k', '0', 29)} < 0.3::double then (ret + market) * vol else ret end as s from t, sh)") + "select scenario, portfolio, round(product(1 + s) - 1, 6) as total, round(stddev_samp(s) * sqrt(252), 6) as volatility, round(corr(ret, s), 6) as corr from x group by 1, 2")
def _(spark, sf):
    return rd(sc.factor_shocks(prets(spark, sf), spark.createDataFrame(_SHOCKS, "scenario string, market double, vol double"), 0.3, 29), ["scenario", "portfolio"])


@query("scn06_normal_stress", sql.bars("y", PSQL + f", {_SHSQL}, z as (select portfolio, avg(ret) as mu, stddev_pop(ret) as sd from pr group by 1), mc as (select scenario, portfolio, mu + market + sd * vol * {rng.normal_sql('k', '0', 31)} as x from z, sh, (select unnest(range(1000)) as k)), " + _outcome_sql("mc", "scenario, portfolio", "x")) + "select scenario, portfolio, round(max(p05), 6) as var_95, round(avg(x) filter (where x <= p05), 6) as expected_shortfall from mc join oq using (scenario, portfolio) group by 1, 2")
def _(spark, sf):
    shocks = spark.createDataFrame(_SHOCKS, "scenario string, mean_shift double, vol_scale double")
    return rd(sc.normal_stress(prets(spark, sf), shocks, 1000, 31), ["scenario", "portfolio"])


@query("scn07_path_rules", sql.bars("y", PSQL + f""", t as (select *, row_number() over (partition by portfolio order by ts) as k, count(*) over (partition by portfolio) as n from pr), x as (select 'crash' as rule, portfolio, case when k = floor(n / 2) then -0.2 else ret end as s from t union all select 'volatility_spike', portfolio, case when k > floor(n / 3) and k <= floor(n / 3) + 20 then ret * 2 else ret end from t
    union all select 'drift', portfolio, ret - 0.001 from t union all select 'black_swan', portfolio, case when {rng.uniform_sql('k', '1', 37)} < 0.01::double then ret - 0.05 else ret end from t)""") + "select rule, portfolio, round(product(1 + s) - 1, 6) as total, round(stddev_samp(s) * sqrt(252), 6) as volatility from x group by 1, 2")
def _(spark, sf):
    return rd(sc.path_rules(prets(spark, sf), 37), ["rule", "portfolio"])


# Parameter search: momentum over a grid of lookbacks and thresholds, all candidates in one plan.
_LOOK, _THR = [5, 10, 20], [0.005, 0.01, 0.02]


def scored(bars, params):
    """(symbol, params_id, lookback, threshold, score): the Sharpe ratio of each candidate."""
    looks = sorted({row.lookback for row in params.select("lookback").distinct().collect()})  # the grid's own values
    wide = ind.with_returns(bars).withColumns({f"m{n}": win.simple_return("close", n) for n in looks})
    long = wide.crossJoin(F.broadcast(params))
    move = F.coalesce(*[F.when(F.col("lookback") == n, F.col(f"m{n}")) for n in looks])
    long = long.withColumn("signal", F.when(move > F.col("threshold"), 1).when(move < -F.col("threshold"), -1).otherwise(0))
    w = win.Window.partitionBy("symbol", "params_id").orderBy("ts")
    long = long.withColumn("sr", F.coalesce(F.lag("signal").over(w), F.lit(0)) * F.coalesce("ret", F.lit(0.0)))
    return long


def _score(long, *keys):
    return long.groupBy("symbol", *keys, "params_id", "lookback", "threshold").agg(m.sharpe(F.col("sr")).alias("score"))


_GRID = "gd as (select (row_number() over (order by l, h) - 1)::int as params_id, l as lookback, h as threshold from (select unnest([5, 10, 20]) as l), (select unnest([0.005::double, 0.01::double, 0.02::double]) as h))"
_LONG = _GRID + f""", mv as (select *, close / {lagged('close', 5)} - 1 as m5, close / {lagged('close', 10)} - 1 as m10, close / {lagged('close', 20)} - 1 as m20 from r), lg as (select mv.*, gd.*, case lookback when 5 then m5 when 10 then m10 else m20 end as mo from mv, gd),
    sg as (select *, case when mo > threshold then 1 when mo < -threshold then -1 else 0 end as sig from lg), sv as (select *, coalesce(lag(sig) over (partition by symbol, params_id order by ts), 0) * coalesce(ret, 0) as sr from sg)"""
_SC = _LONG + ", so as (select symbol, params_id, lookback, threshold, avg(sr) / nullif(stddev_samp(sr), 0) * sqrt(252) as score from sv group by 1, 2, 3, 4)"


def grid_of(spark):
    return opt.grid(spark, {"lookback": _LOOK, "threshold": _THR})


@query("opt01_04_06_08_grid_search", sql.bars("x", _SC) + "select symbol, params_id, cast(lookback as int) as lookback, threshold, round(score, 6) as score from so qualify row_number() over (partition by symbol order by score desc, params_id) = 1")
def _(spark, sf):
    best = opt.best(_score(scored(damped_hourly(spark, sf), grid_of(spark))), ["symbol"])
    return best.select("symbol", "params_id", "lookback", "threshold", r(F.col("score")).alias("score"))


@query("srt03_top_results", sql.bars("x", _SC) + "select symbol, params_id, round(score, 6) as score from so order by score desc nulls last, params_id, symbol limit 10")
def _(spark, sf):
    return opt.top(_score(scored(damped_hourly(spark, sf), grid_of(spark))), 10).select("symbol", "params_id", r(F.col("score")).alias("score"))


@query("srt06_random_subset", f"with {_GRID} select params_id, cast(lookback as int) as lookback, threshold from gd order by {rng.draw_sql('params_id', '0', 41)}, params_id limit 4")
def _(spark, sf):
    return opt.random_subset(grid_of(spark), 4, 41)


_U = lambda k: rng.uniform_sql("params_id", str(k), 43)


@query("opt02_random_candidates", f"select params_id, round({_U(0)} * 0.045::double + 0.005::double, 8) as threshold, round(exp({_U(1)} * (ln(1.0) - ln(0.001)) + ln(0.001)), 8) as rate, cast(floor({_U(2)} * 26 + 5) as bigint) as lookback, ['a', 'b', 'c'][cast(floor({_U(3)} * 3) as int) + 1] as kind from (select unnest(range(50)) as params_id)")
def _(spark, sf):
    out = opt.random_candidates(spark, {"threshold": ("uniform", 0.005, 0.05), "rate": ("log_uniform", 0.001, 1.0), "lookback": ("int", 5, 30), "kind": ("choice", ["a", "b", "c"])}, 50, 43)
    return out.select("params_id", r(F.col("threshold"), 8).alias("threshold"), r(F.col("rate"), 8).alias("rate"), "lookback", "kind")


_FOLDS = "fo as (select unnest(range(100000)) as fold), nb as (select symbol, max(t) + 1 as n from sv group by 1), fb as (select symbol, fold, 126 + fold * 63 as a from nb, fo where 126 + fold * 63 + 252 < n), inf as (select sv.*, fold, case when t < a + 252 then 'train' else 'test' end as part from sv join fb on sv.symbol = fb.symbol and t >= a and t < a + 315)"
WALK_SQL = _LONG + ", " + _FOLDS + """, ps as (select symbol, fold, params_id, lookback, threshold, avg(sr) filter (where part = 'train') / nullif(stddev_samp(sr) filter (where part = 'train'), 0) * sqrt(252) as score, avg(sr) filter (where part = 'test') / nullif(stddev_samp(sr) filter (where part = 'test'), 0) * sqrt(252) as oos from inf group by 1, 2, 3, 4, 5)"""


def walk_forward(spark, sf):
    """The best candidate of every symbol and fold, with its score in the fold's training and test bars."""
    inside = opt.in_folds(scored(damped_hourly(spark, sf), grid_of(spark)))
    part = lambda p: F.when(F.col("part") == p, F.col("sr"))
    s = inside.groupBy("symbol", "fold", "params_id", "lookback", "threshold").agg(m.sharpe(part("train")).alias("score"), m.sharpe(part("test")).alias("oos"))
    return opt.best(s, ["symbol", "fold"])


@query("opt05_walk_forward", sql.bars("x", WALK_SQL) + "select symbol, fold::int as fold, params_id, round(score, 6) as train_score, round(oos, 6) as test_score from ps qualify row_number() over (partition by symbol, fold order by score desc, params_id) = 1")
def _(spark, sf):
    return walk_forward(spark, sf).select("symbol", "fold", "params_id", r(F.col("score")).alias("train_score"), r(F.col("oos")).alias("test_score"))


@query("opt03_bayesian_search")
def _(spark, sf):
    bars = written(damped_hourly(spark, sf), "search-bars")

    def evaluate(points):
        rows = [(k, int(round(x[0])), float(x[1])) for k, x in enumerate(points)]
        params = spark.createDataFrame(rows, "params_id int, lookback int, threshold double")
        found = _score(scored(bars, params)).groupBy("params_id").agg(F.avg("score").alias("s")).collect()
        by = {row.params_id: row.s for row in found}
        return [by.get(k) if by.get(k) is not None else float("-inf") for k in range(len(points))]

    history = bayes.search(evaluate, [(3, 40), (0.002, 0.05)], rounds=3, batch=4, seed=3)
    return spark.createDataFrame([(k, int(round(x[0])), float(x[1]), float(s)) for k, (x, s) in enumerate(history)], "step int, lookback int, threshold double, score double")


@query("opt07_composite_grid", "with g as (select (row_number() over (order by a, b, c, d, e) - 1)::int as params_id, a, b, c, d, e from (select unnest([40, 60, 80]) as a), (select unnest([1.5::double, 2.0::double, 2.5::double]) as b), (select unnest([0.3::double, 0.5::double, 2.0::double]) as c), (select unnest([20, 30, 40]) as d), (select unnest([0.005::double, 0.01::double, 0.02::double]) as e)) select params_id, a as \"window\", b as z_entry, c as z_exit, d as te_window, e as gate from g where c < b")
def _(spark, sf):
    g = opt.grid(spark, {"window": [40, 60, 80], "z_entry": [1.5, 2.0, 2.5], "z_exit": [0.3, 0.5, 2.0], "te_window": [20, 30, 40], "gate": [0.005, 0.01, 0.02]})
    return g.where("z_exit < z_entry")


def _checks_sql(key: str, source: str, checks: dict[str, tuple[str, str]]) -> str:
    return " union all ".join(f"select {key} as subject, '{n}' as \"check\", '{lv}' as level, coalesce({e}, false) as failed from {source} group by 1" for n, (lv, e) in checks.items())


_VR = {"too_few": ("error", "count(*) < 30"), "nulls": ("error", "count(*) filter (where ret is null) > 0"), "infinite": ("error", "count(*) filter (where isinf(ret)) > 0"), "above_100_percent": ("warning", "max(ret) > 1"), "below_minus_100_percent": ("warning", "min(ret) < -1"), "constant": ("warning", "stddev_samp(ret) = 0")}
_VP = {"empty": ("error", "count(*) = 0"), "nulls": ("error", "count(*) filter (where close is null) > 0"), "infinite": ("error", "count(*) filter (where isinf(close)) > 0"), "negative": ("error", "count(*) filter (where close < 0) > 0"), "zero": ("warning", "count(*) filter (where close = 0) > 0"), "constant": ("warning", "max(close) = min(close)")}
_VW = {"nulls": ("error", "count(*) filter (where w is null) > 0"), "infinite": ("error", "false"), "negative": ("error", "count(*) filter (where w < 0) > 0"), "not_one": ("error", "abs(sum(w) - 1) > 1e-6"), "leverage": ("error", "sum(abs(w)) > 1.000001")}


@query("val01_02_03_10_validation_report", sql.bars("h", WSQL) + _checks_sql("symbol", "r", _VR) + " union all " + _checks_sql("symbol", "bars", _VP) + " union all " + _checks_sql("portfolio", "wt", _VW))
def _(spark, sf):
    bars = hourly(spark, sf)
    return val.report(val.returns(ind.with_returns(bars)), val.prices(bars), val.weights(weights(spark)))


@query("val04_dates", "with e as (select *, lag(ts) over (partition by event_type order by event_id) as b from events) " + _checks_sql("event_type", "e", {"nulls": ("error", "count(*) filter (where ts is null) > 0"), "unsorted": ("error", "count(*) filter (where b > ts) > 0"), "repeated": ("error", "count(ts) > count(distinct ts)")}))
def _(spark, sf):
    from ..sources.bars import table

    return val.dates(table(spark, sf, "events"), "event_type", "ts", "event_id")


@query("val06_trades", sql.bars("h", "t as (select symbol, volume as size, open as entry_price, 1 as direction from r)") + _checks_sql("symbol", "t", {"no_quantity": ("error", "count(*) filter (where size = 0) > 0"), "price": ("error", "count(*) filter (where entry_price <= 0) > 0"), "side": ("error", "count(*) filter (where direction not in (1, -1)) > 0")}))
def _(spark, sf):
    t = hourly(spark, sf).select("symbol", F.col("volume").alias("size"), F.col("open").alias("entry_price"), F.lit(1).alias("direction"))
    return val.trades(t)


@query("val05_07_08_09_checks_of_parameters_matrices_metrics")
def _(spark, sf):
    base = rets(spark, sf)
    _, corr = pf.matrix(m.covariance(base), "corr")
    wrong = val.correlation(corr) + val.parameters({"lookback": 100, "threshold": 0.02}, sig.BOUNDS["momentum"]) + val.bounds({"lookback": (5, 60), "threshold": (0.1, 0.1)})
    rows = spark.createDataFrame([("parameters", w, "error", True) for w in wrong], "subject string, check string, level string, failed boolean")
    return rows.unionByName(val.metrics(m.performance(base)))


_VM = {"sharpe": "abs(sharpe) > 5", "total_return": "total_return > 10", "volatility": "volatility > 2", "drawdown": "max_drawdown < -0.9"}


@query("val08_metric_warnings", sql.bars("h", "p0 as (select symbol, ts, ret, product(1 + ret) over (partition by symbol order by ts rows unbounded preceding) as eq from r where ret is not null), p as (select *, eq / max(eq) over (partition by symbol order by ts rows unbounded preceding) - 1 as dd from p0), q as (select symbol, product(1 + ret) - 1 as total_return, stddev_samp(ret) * sqrt(252) as volatility, (avg(ret) - 0.02 / 252) / nullif(stddev_samp(ret), 0) * sqrt(252) as sharpe, min(dd) as max_drawdown from p group by 1)")
    + " union all ".join(f"select symbol as subject, '{n}' as \"check\", 'warning' as level, coalesce({e}, false) as failed from q" for n, e in _VM.items()))
def _(spark, sf):
    """Of raw bars, whose moves are large enough to be warned of."""
    return val.metrics(m.performance(ind.with_returns(hourly(spark, sf))))
