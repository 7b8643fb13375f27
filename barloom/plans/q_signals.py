"""Trading rules and backtests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import windows as win
from ..operators import backtest as bt
from ..operators import indicators as ind
from ..operators import metrics as m
from ..operators import signals as sig
from . import sql
from .q_windows import ADX_SQL, PAIR_SQL, RSI_SQL, TR_SQL, daily, damped_hourly, damped_weekly, hourly, pair, r, rounded, weekly
from .registry import query

BARS_OF = {"h": hourly, "d": daily, "w": weekly, "x": damped_hourly, "y": damped_weekly}


def case(buy: str, sell: str | None = None) -> str:
    return f"cast(case when {buy} then 1 {f'when {sell} then -1' if sell else ''} else 0 end as int)"


def lagged(x: str, n: int) -> str:
    return f"lag({x}, {n}) over (partition by symbol order by ts)"


MOM20 = f"(close / {lagged('close', 20)} - 1)"
VOLR = f"coalesce({sql.full('avg', 'volume', 10, -10, -1)} / nullif({sql.full('avg', 'volume', 10, -20, -11)}, 0), 1)"


def rule_query(name: str, kind: str, rule, expression: str, more: str = "", source: str = "r", extra: dict[str, str] | None = None) -> None:
    """Register a rule over bars of a kind with the SQL expression of its signal."""
    extra = extra or {}
    columns = "".join(f", round({e}, 6) as {c}" for c, e in extra.items())

    @query(name, sql.bars(kind, more) + f"select {source}.symbol, {source}.ts, {expression} as signal{columns} from {source}")
    def _(spark, sf):
        return rule(BARS_OF[kind](spark, sf)).select("symbol", "ts", "signal", *[r(F.col(c)).alias(c) for c in extra])


rule_query("sig01_momentum", "h", sig.momentum, case(f"{MOM20} > 0.02", f"{MOM20} < -0.02"))
rule_query("sig02_volume_momentum", "h", sig.volume_momentum, case(f"{MOM20} > 0.02 and {VOLR} > 1.2", f"{MOM20} < -0.02 and {VOLR} > 1.2"))
rule_query(
    "sig03_risk_adjusted_momentum", "h", sig.risk_adjusted_momentum, case(f"{MOM20} > 0.02", f"{MOM20} < -0.02"),
    extra={"size_factor": f"least(coalesce(0.15 / nullif({sql.full('stddev_samp', 'ret', 29, -29, -1)} * {252**.5!r}, 0), 1), 3)"},
)
rule_query(
    "sig04_dual_momentum", "w", sig.dual_momentum, case(f"m > 0 and {sql.sma('ret', 6)} > {sql.sma('bench', 6)}"), source="y",
    more=f"b as (select ts, avg(ret) as bench from r group by 1), y as (select r.*, bench, close / {lagged('close', 12)} - 1 as m from r join b using (ts))",
)
rule_query(
    "sig05_cross_sectional_momentum", "w", sig.cross_sectional_momentum, case("usable and best <= 1", "usable and worst <= 1"), source="z",
    more=f"""y0 as (select *, {MOM20} as m from r), y as (select *, m is not null and (t - 20) % 5 = 0 as live from y0),
    z as (select *, live and count(*) over (partition by ts, live) >= 2 as usable, row_number() over (partition by ts, live order by m desc nulls last, symbol) as best, row_number() over (partition by ts, live order by m nulls first, symbol desc) as worst from y)""",
)
rule_query(
    "sig06_bollinger_rsi", "h", sig.bollinger_rsi, case("t >= 20 and close <= mid - 2 * sd and rsi <= 30", "t >= 20 and close >= mid + 2 * sd and rsi >= 70"), source="y",
    more=RSI_SQL + f", y as (select *, {sql.sma('close', 20)} as mid, {sql.std('close', 20)} as sd from rs)",
)
rule_query("sig10_mean_reversion", "h", sig.mean_reversion, case(f"close < {sql.sma('close', 21)} * 0.98", f"close > {sql.sma('close', 21)} * 1.02"))
rule_query(
    "sig11_crossover", "h", sig.crossover, case("x > 0 and p <= 0", "x < 0 and p >= 0"), source="z",
    more=f"y as (select *, {sql.sma('close', 10)} - {sql.sma('close', 30)} as x from r), z as (select *, {lagged('x', 1)} as p from y)",
)
rule_query(
    "sig12_triple_average", "h", sig.triple_average, case("a > b and b > c", "a < b and b < c"), source="y",
    more=f"y as (select *, {sql.sma('close', 5)} as a, {sql.sma('close', 20)} as b, {sql.sma('close', 50)} as c from r)",
)
rule_query(
    "sig13_breakout", "h", sig.breakout, case("high > hi * 1.02 and volume >= 1.5 * v", "low < lo * 0.98 and volume >= 1.5 * v"), source="y",
    more=f"y as (select *, {sql.full('max', 'high', 20, -20, -1)} as hi, {sql.full('min', 'low', 20, -20, -1)} as lo, {sql.full('avg', 'volume', 20, -20, -1)} as v from r)",
)
rule_query(
    "sig15_trend_filter", "h", sig.trend_filter, case("a10 > a50 and adx > 25 and rsi < 70", "a10 < a50 and adx > 25 and rsi > 30"), source="y",
    more=RSI_SQL + ", " + TR_SQL + f""", av as (select symbol, ts, {sql.sma('close', 10)} as a10, {sql.sma('close', 50)} as a50 from r), dx as (select symbol, ts, {ADX_SQL} as adx from ax),
    y as (select rs.*, adx, a10, a50 from rs join dx using (symbol, ts) join av using (symbol, ts))""",
)
rule_query("sig17_trend_following", "h", sig.trend_following, case(f"{sql.sma('close', 10)} > {sql.sma('close', 31)}", f"{sql.sma('close', 10)} < {sql.sma('close', 31)}"))
rule_query("sig18_volatility_breakout", "h", sig.volatility_breakout, case(f"ret > 2 * {sql.std('ret', 20)}", f"ret < -2 * {sql.std('ret', 20)}"))

_FF = f"last_value({{}} ignore nulls) {sql.over('u')}"
rule_query(
    "sig09_ornstein_uhlenbeck", "d", sig.ornstein_uhlenbeck, case("close < exp(mu - w)", "close > exp(mu + w)"), source="q",
    more=f"""y as (select *, ln(close / {lagged('close', 1)}) as dy, ln({lagged('close', 1)}) as dx from r),
    f as (select *, case when t >= 100 and (t - 100) % 20 = 0 then regr_slope(dy, dx) {sql.over(-99, -1)} end as b0, case when t >= 100 and (t - 100) % 20 = 0 then regr_intercept(dy, dx) {sql.over(-99, -1)} end as a0,
        case when t >= 100 and (t - 100) % 20 = 0 then sqrt(var_pop(dy) {sql.over(-99, -1)} * (1 - pow(corr(dy, dx) {sql.over(-99, -1)}, 2))) end as s0 from y),
    g as (select *, {_FF.format('b0')} as b, {_FF.format('a0')} as a, {_FF.format('s0')} as s from f),
    q as (select *, -a / nullif(b, 0) as mu, 1.959963984540054 * s / sqrt(2 * case when b < 0 then -b else 0.1 end) as w from g)""",
)


def machine(rows: str, enter: str, step_long: str, step_short: str) -> str:
    """The position of each bar by walking the bars one by one: an oracle that shares nothing with the windows it checks.

    rows: a CTE with symbol, t, ts and what the expressions name; the expressions give the next position from flat, long and short.
    """
    return f"""walk as (select symbol, t, ts, {enter} as position, {enter} as signal from {rows} where t = 0 union all
        select n.symbol, n.t, n.ts, n.position, case when n.position <> n.was then n.position else 0 end from (
        select {rows}.symbol, {rows}.t, {rows}.ts, w.position as was, case w.position when 0 then {enter} when 1 then {step_long} else {step_short} end as position from walk w join {rows} on {rows}.symbol = w.symbol and {rows}.t = w.t + 1) n)"""


def walk_query(name: str, kind: str, rule, more: str, enter: str, step_long: str, step_short: str) -> None:
    text = (sql.bars(kind, more + ", " + machine("y", enter, step_long, step_short))).replace("with bars", "with recursive bars", 1)

    @query(name, text + "select symbol, ts, cast(position as int) as position, cast(signal as int) as signal from walk")
    def _(spark, sf):
        return rule(BARS_OF[kind](spark, sf)).select("symbol", "ts", "position", "signal")


_Z60 = f"y as materialized (select symbol, ts, t, (close - {sql.full('avg', 'close', 60, -60, -1)}) / nullif({sql.full('stddev_samp', 'close', 60, -60, -1)}, 0) as z from r)"
walk_query("sig07_statistical_arbitrage", "h", sig.statistical_arbitrage, _Z60, "(case when z <= -2 then 1 when z >= 2 then -1 else 0 end)", "(case when z >= -0.5 or z <= -3 then -1 else 1 end)", "(case when z <= 0.5 or z >= 3 then 1 else -1 end)")
_SP = f"""s as (select *, case when t >= 20 then ln(close / avg(close) {sql.over(-19)}) else 0 end as sp from r),
    f as (select *, case when t >= 60 and (t - 60) % 20 = 0 then avg(sp) {sql.over(-60, -1)} end as m0, case when t >= 60 and (t - 60) % 20 = 0 then stddev_pop(sp) {sql.over(-60, -1)} end as s0 from s),
    y as materialized (select symbol, ts, t, (sp - {_FF.format('m0')}) / nullif({_FF.format('s0')}, 0) as z from f)"""
walk_query("sig08_pairs", "h", sig.pairs, _SP, "(case when z <= -2 then 1 when z >= 2 then -1 else 0 end)", "(case when abs(z) <= 0.5 then -1 else 1 end)", "(case when abs(z) <= 0.5 then 1 else -1 end)")
_DC = f"""y as materialized (select symbol, ts, t, close, {sql.full('max', 'high', 20, -20, -1)} as hi, {sql.full('min', 'low', 20, -20, -1)} as lo, {sql.full('max', 'high', 10, -10, -1)} as oh, {sql.full('min', 'low', 10, -10, -1)} as ol from r)"""
walk_query("sig14_donchian", "h", sig.donchian, _DC, "(case when close > hi then 1 when close < lo then -1 else 0 end)", "(case when close < ol then -1 else 1 end)", "(case when close > oh then 1 else -1 end)")


@query("sig16_simple_pairs", sql.bars("h", f"y as materialized (select symbol, ts, t, (close - {sql.sma('close', 31)}) / nullif({sql.std('close', 31)}, 0) as z from r), " + machine("y", "(case when z > 2 then -1 when z < -2 then 1 else 0 end)", "(case when abs(z) < 0.5 then 0 else 1 end)", "(case when abs(z) < 0.5 then 0 else -1 end)")).replace("with bars", "with recursive bars", 1)
    + f"select symbol, ts, cast(position as int) as position, cast(signal as int) as signal, coalesce(position = 0 and {lagged('position', 1)} <> 0, false) as is_exit from walk")
def _(spark, sf):
    return sig.simple_pairs(hourly(spark, sf)).select("symbol", "ts", "position", "signal", "is_exit")


_TE = """st as (select sp.t + k as t, sp.t as s, ra as x, rb as y from sp, (select unnest(range(30)) as k) where ra is not null and rb is not null), c1 as (select *, count(*) over (partition by t) as n from st),
    c2 as (select *, coalesce(least(floor((x - min(x) over w) / nullif(max(x) over w - min(x) over w, 0) * 10), 9), 0) as bx, coalesce(least(floor((y - min(y) over w) / nullif(max(y) over w - min(y) over w, 0) * 10), 9), 0) as by_ from c1 where n = 30 window w as (partition by t)),
    c3 as (select *, lag(bx) over (partition by t order by s) as px, lag(by_) over (partition by t order by s) as py from c2), c4 as (select * from c3 where px is not null),
    te as (select t, avg(ln(a * b / (c::double * d))) as te_xy, avg(ln(e * f / (c::double * g))) as te_yx from (select t, count(*) over (partition by t, by_, py, px) as a, count(*) over (partition by t, py) as b, count(*) over (partition by t, py, px) as c, count(*) over (partition by t, by_, py) as d,
        count(*) over (partition by t, bx, px, py) as e, count(*) over (partition by t, px) as f, count(*) over (partition by t, bx, px) as g from c4) group by 1)"""


@query("sig20_transfer_entropy", sql.bars("w", PAIR_SQL + ", " + _TE) + "select t, round(te_xy, 6) as te_xy, round(te_yx, 6) as te_yx, round(te_xy / (te_yx + 1e-8), 6) as ratio from te")
def _(spark, sf):
    p = pair(spark, sf).withColumns({"t": F.row_number().over(win.spec()) - 1, "ra": win.simple_return("a"), "rb": win.simple_return("b")})
    te = sig.transfer_entropy(p.withColumn("t", F.col("t").cast("long")), "ra", "rb")
    return te.select("t", r(F.col("te_xy")).alias("te_xy"), r(F.col("te_yx")).alias("te_yx"), r(F.col("te_xy") / (F.col("te_yx") + 1e-8)).alias("ratio"))


_COMPOSITE = PAIR_SQL + ", " + _TE + f""", cz as (select sp.*, case when sp.t >= 119 then (spread - avg(spread) {sql.over(-59)}) / nullif(stddev_pop(spread) {sql.over(-59)}, 0) end as z from sp),
    y as materialized (select cz.symbol, cz.ts, cz.t, z, coalesce(greatest(te_xy, te_yx) >= 0.01, false) as open_, te_xy / (te_yx + 1e-8) as ratio from cz left join te on te.t = cz.t - 1)"""


_COMPOSITE_WALK = (sql.bars("w", _COMPOSITE + ", " + machine("y", "(case when open_ and z > 1.5 and ratio < 1 then -1 when open_ and z < -1.5 and ratio > 1 then 1 else 0 end)", "(case when open_ and abs(z) < 0.5 then 0 else 1 end)", "(case when open_ and abs(z) < 0.5 then 0 else -1 end)"))).replace("with bars", "with recursive bars", 1)


@query("sig19_composite_pair", _COMPOSITE_WALK
    + "select ts, cast(position as int) as position, cast(signal as int) as signal from walk")
def _(spark, sf):
    return sig.composite_pair(pair(spark, sf), entry=1.5).select("ts", "position", "signal")


def peeking(bars):
    """A rule that looks ahead on purpose: it knows the next close."""
    after = F.lead("close").over(win.spec())
    return ind.with_returns(bars).withColumn("signal", F.when(after > F.col("close"), 1).when(after < F.col("close"), -1).otherwise(0))


@query("sig22_look_ahead_validator", sql.bars("h", "pk as (select symbol, t, case when lead(close) over w > close then 1 when lead(close) over w < close then -1 else 0 end as sig from r window w as (partition by symbol order by ts))") + "select rule, symbol, case rule when 'peeking' then count(*) filter (where sig <> 0) else 0 end as violations from pk, (select unnest(['momentum', 'bollinger_rsi', 'peeking']) as rule) where t in (25, 60, 200) group by 1, 2")
def _(spark, sf):
    """Rules without and with a look ahead, cut at three bars. SQL states that the last bar of a cut has no signal of the rule that peeks, and all bars those of the others."""
    bars, at = hourly(spark, sf), [25, 60, 200]
    out = None
    for rule in (sig.momentum, sig.bollinger_rsi, peeking):
        found = sig.look_ahead_violations(bars, rule, at).groupBy("symbol").agg(F.count("*").alias("violations"))
        part = bars.select("symbol").distinct().join(found, "symbol", "left").select(F.lit(rule.__name__).alias("rule"), "symbol", F.coalesce("violations", F.lit(0)).cast("long").alias("violations"))
        out = part if out is None else out.unionByName(part)
    return out


_SIG1 = f"sg as (select *, {case(f'{MOM20} > 0.02', f'{MOM20} < -0.02')} as signal from r)"
VECTOR = _SIG1 + f""", v0 as (select *, coalesce({lagged('signal', 1)}, 0) as pos from sg), v as (select *, coalesce(pos * ret, 0) - abs(pos - coalesce({lagged('pos', 1)}, 0)) * 0.001 as sret from v0),
    ve as (select *, product(1 + sret) {sql.over('u')} as equity, product(1 + coalesce(ret, 0)) {sql.over('u')} as buy_hold from v), vd as (select *, equity / max(equity) {sql.over('u')} - 1 as dd from ve)"""


@query("sim01_vector_backtest", sql.bars("h", VECTOR) + "select symbol, ts, signal, round(sret, 8) + 0.0 as strategy_ret, round(equity, 8) + 0.0 as equity, round(buy_hold, 8) + 0.0 as buy_hold from vd")
def _(spark, sf):
    run = bt.vector_backtest(sig.momentum(hourly(spark, sf)), fee=0.001)
    return rounded(run, ["symbol", "ts", "signal"], ["strategy_ret", "equity", "buy_hold"], 8)


@query("sim09_buy_and_hold", sql.bars("h", VECTOR) + "select symbol, round(arg_max(buy_hold, ts) - 1, 6) as total_return, round(avg(ret) / stddev_samp(ret) * sqrt(252), 6) as sharpe, round(stddev_samp(ret) * sqrt(252), 6) as volatility, count(*) as bars from vd group by 1")
def _(spark, sf):
    run = bt.vector_backtest(sig.momentum(hourly(spark, sf)))
    return run.groupBy("symbol").agg(r(F.max_by("buy_hold", "ts") - 1).alias("total_return"), r(m.sharpe(F.col("ret"))).alias("sharpe"), r(m.volatility(F.col("ret"))).alias("volatility"), F.count("*").alias("bars"))


def loop(compat: bool) -> str:
    """The event loop itself, bar by bar, over cash, units, side and entry price."""
    k = "0.0011"
    back = f"e.units * y.close - e.units * y.close * {k}" + (f" + (y.close - e.entry) * e.units - e.units * y.close * {k}" if compat else "")
    against = "(y.signal <> 0 and e.side <> 0 and e.side <> y.signal)"
    free = f"(case when not {against} then e.cash when e.side = 1 then e.cash + {back} else e.cash + (e.entry - y.close) * e.units - e.units * y.close * {k} end)"
    return f"""ev as (select symbol, t, ts, close, 100000::double as cash, 0::double as units, 0 as side, 0::double as entry, 0 as epoch from y where t = -1 union all
        select symbol, t, ts, close, case when opens and signal = 1 then free - new * close * (1 + {k}) when opens then free - new * close * {k} else free end,
            case when opens then new when held = 0 then 0 else units end, case when opens then signal else held end, case when opens then close else entry end, epoch + (opens or held <> side)::int from (
            select *, signal <> 0 and held = 0 and new >= 0.01 and (signal = -1 or free > 0) as opens from (
                select y.symbol, y.t, y.ts, y.close, y.signal, e.units, e.entry, e.side, e.epoch, {free} as free, case when {against} then 0 else e.side end as held, abs({free} * 0.95 / (y.close * (1 + {k}))) as new
                from ev e join y on y.symbol = e.symbol and y.t = e.t + 1)))"""


def _loop_query(name: str, kind: str, compat: bool) -> None:
    rows = f"{_SIG1}, y as materialized (select symbol, t, ts, close, signal from sg union all select distinct symbol, -1, null, null, 0 from sg), " + loop(compat)

    @query(name, sql.bars(kind, rows).replace("with bars", "with recursive bars", 1) + "select symbol, ts, side as direction, round(case side when 1 then cash + units * close when -1 then cash + units * (entry - close) else cash end, 4) as equity, epoch from ev where t >= 0")
    def _(spark, sf):
        run = bt.event_backtest(sig.momentum(BARS_OF[kind](spark, sf)), compat=compat)
        return run.select("symbol", "ts", "direction", r(F.col("equity"), 4).alias("equity"), F.col("epoch").cast("int").alias("epoch"))


_loop_query("sim02_03_04_05_06_event_backtest", "x", False)
_loop_query("sim02_event_backtest_compat", "x", True)
_loop_query("sim02_event_backtest_used_up_accounts", "h", False)

_ALGEBRA = _SIG1 + f""", d0 as (select *, coalesce(last_value(case when signal <> 0 then signal end ignore nulls) {sql.over('u')}, 0) as dir from sg), d1 as (select *, (dir <> coalesce({lagged('dir', 1)}, 0))::int as fresh from d0),
    d2 as (select *, sum(fresh) {sql.over('u')} as epoch from d1), d3 as (select *, first_value(close) over (partition by symbol, epoch order by ts) as entry, lead(close) over (partition by symbol order by ts) as nc, lead(ts) over (partition by symbol order by ts) as nts from d2),
    e0 as (select symbol, epoch, max(dir) as dir, min(ts) as entry_ts, coalesce(last(nts order by ts), max(ts)) as exit_ts, max(entry) as entry, coalesce(last(nc order by ts), arg_max(close, ts)) as exit, count(*) as bars from d3 group by 1, 2),
    e1 as (select *, case dir when 1 then 1 - (0.95 / 1.0011) * 1.0011 + (0.95 / 1.0011) * exit / entry * (1 - 0.0011) when -1 then 1 - 0.0011 * (0.95 / 1.0011) + (0.95 / 1.0011) - (0.95 / 1.0011) * 1.0011 * exit / entry else 1 end as f from e0),
    e2 as (select *, 100000 * coalesce(product(f) over (partition by symbol order by epoch rows between unbounded preceding and 1 preceding), 1) as c from e1),
    tr as (select *, dir * (0.95 / 1.0011) * c / entry as size from e2 where dir <> 0), tp as (select *, (exit - entry) * size - abs(size) * exit * 0.0011 as pnl from tr)"""


def _trades(spark, sf):
    return bt.trades(bt.event_backtest(sig.momentum(damped_hourly(spark, sf))))


@query("trd01_trades", sql.bars("x", _ALGEBRA) + "select symbol, cast(dir as int) as direction, entry_ts, exit_ts, round(entry, 6) as entry_price, round(exit, 6) as exit_price, round(size, 4) + 0.0 as size, round(pnl, 4) + 0.0 as pnl, round(pnl / abs(size * entry), 6) + 0.0 as return_pct, bars, date_diff('day', entry_ts, exit_ts) as days from tp")
def _(spark, sf):
    t = _trades(spark, sf)
    return t.select("symbol", "direction", "entry_ts", "exit_ts", r(F.col("entry_price")).alias("entry_price"), r(F.col("exit_price")).alias("exit_price"), r(F.col("size"), 4).alias("size"), r(F.col("pnl"), 4).alias("pnl"), r(F.col("return_pct")).alias("return_pct"), "bars", "days")


@query("trd01_02_trade_metrics", sql.bars("x", _ALGEBRA) + """select symbol, count(*) as num_trades, round(avg((pnl > 0)::double), 6) as win_rate, round(coalesce(sum(pnl) filter (where pnl > 0), 0) / sum(-pnl) filter (where pnl < 0), 6) as profit_factor, round(avg(pnl) filter (where pnl > 0), 4) as avg_win, round(avg(pnl) filter (where pnl < 0), 4) as avg_loss,
    round(max(pnl), 4) as largest_win, round(min(pnl), 4) as largest_loss, round(sum(pnl), 4) as total_pnl, round(avg(date_diff('day', entry_ts, exit_ts)), 6) as avg_days, round(stddev_pop(pnl), 4) as std_pnl, round(quantile_cont(pnl, 0.5), 4) as median_pnl, round(quantile_cont(pnl, 0.9), 4) as p90_pnl from tp group by 1""")
def _(spark, sf):
    t = bt.trade_metrics(_trades(spark, sf))
    four = [r(F.col(c), 4).alias(c) for c in ("avg_win", "avg_loss", "largest_win", "largest_loss", "total_pnl", "std_pnl")]
    return t.select("symbol", "num_trades", r(F.col("win_rate")).alias("win_rate"), r(F.col("profit_factor")).alias("profit_factor"), *four, r(F.col("avg_days")).alias("avg_days"), r(F.col("pnl_percentiles")[2], 4).alias("median_pnl"), r(F.col("pnl_percentiles")[4], 4).alias("p90_pnl"))


@query("trd03_monthly_trades", sql.bars("x", _ALGEBRA) + "select symbol, strftime(entry_ts, '%Y-%m') as month, count(*) as trades, round(sum(pnl), 4) as total_pnl, round(avg((pnl > 0)::double), 6) as win_rate from tp group by 1, 2")
def _(spark, sf):
    t = _trades(spark, sf).withColumn("month", F.date_format("entry_ts", "yyyy-MM"))
    return t.groupBy("symbol", "month").agg(F.count("*").alias("trades"), r(F.sum("pnl"), 4).alias("total_pnl"), r(F.avg((F.col("pnl") > 0).cast("double"))).alias("win_rate"))


_EQUITY = f"""q0 as (select d3.symbol, d3.ts, c * case d3.dir when 1 then 1 - (0.95 / 1.0011) * 1.0011 + (0.95 / 1.0011) * close / d3.entry when -1 then 1 - 0.0011 * (0.95 / 1.0011) + (0.95 / 1.0011) - (0.95 / 1.0011) * close / d3.entry else 1 end as equity from d3 join e2 using (symbol, epoch)),
    q1 as (select *, equity / {lagged('equity', 1)} - 1 as er, equity / max(equity) {sql.over('u')} - 1 as dd from q0)"""


@query("trd04_backtest_metrics", sql.bars("x", _ALGEBRA + ", " + _EQUITY + """, w as (select symbol, avg((pnl > 0)::double) as win_rate, count(*) as num_trades, avg(pnl / abs(size * entry)) as atr from tp group by 1)""")
    + """select symbol, round(arg_max(equity, ts) / arg_min(equity, ts) - 1, 6) as total_return, round(stddev_samp(er) * sqrt(252), 6) as volatility, round(min(dd), 6) as max_drawdown,
    round(case when arg_max(equity, ts) > 0 then pow(arg_max(equity, ts) / arg_min(equity, ts), 252.0 / count(er)) - 1 end, 6) as annualized_return, round(max(win_rate), 6) as win_rate, max(num_trades) as num_trades, round(max(atr), 6) as avg_trade_return from q1 join w using (symbol) group by 1""")
def _(spark, sf):
    run = bt.event_backtest(sig.momentum(damped_hourly(spark, sf)))
    out = bt.run_metrics(run, bt.trades(run))
    return out.select("symbol", "num_trades", *[r(F.col(c)).alias(c) for c in ("total_return", "volatility", "max_drawdown", "annualized_return", "win_rate", "avg_trade_return")])


@query("sim07_08_composite_pair_backtest", _COMPOSITE_WALK + f""", wx as (select symbol, t, ts, signal, position = 0 and coalesce(lag(position) over (partition by symbol order by ts), 0) <> 0 as is_exit from walk),
    pv as (select symbol, ts, a, var_samp(ra) {sql.over(-30, -1)} as va, corr(ra, rb) {sql.over(-30, -1)} as cab from sp), mk as (select wx.*, a, 2000 / (sqrt(va) * 10 + 1) * abs(cab) / a as size from wx join pv using (symbol, ts) where signal <> 0 or is_exit),
    mn as (select *, lead(a) over (partition by symbol order by ts) as ea, lead(ts) over (partition by symbol order by ts) as ets, lead(is_exit) over (partition by symbol order by ts) as closes from mk), tr as (select *, (ea - a) * size * signal as pnl from mn where signal <> 0 and closes)"""
    + "select symbol, ts as entry_ts, ets as exit_ts, cast(signal as int) as signal, round(size, 6) as size, round(pnl, 6) as pnl, round(100000 + sum(pnl) over (partition by symbol order by ts rows unbounded preceding), 6) as equity from tr")
def _(spark, sf):
    p = sig.composite_pair(pair(spark, sf), entry=1.5)
    before = win.rows(-30, -1)
    p = p.withColumns({"var_a": F.var_samp("ra").over(before), "corr_ab": F.corr("ra", "rb").over(before)})
    return rounded(bt.pair_backtest(p), ["symbol", "entry_ts", "exit_ts", "signal"], ["size", "pnl", "equity"])


_BATCH = {"momentum": (f"{MOM20} > 0.02", f"{MOM20} < -0.02"), "mean_reversion": (f"close < {sql.sma('close', 21)} * 0.98", f"close > {sql.sma('close', 21)} * 1.02"), "trend_following": (f"{sql.sma('close', 10)} > {sql.sma('close', 31)}", f"{sql.sma('close', 10)} < {sql.sma('close', 31)}")}


@query("sim10_11_batch_run", sql.bars("h", ", ".join(f"b_{n} as (select '{n}' as rule, symbol, ts, ret, {case(*c)} as signal from r)" for n, c in _BATCH.items()) + ", al as (" + " union all ".join(f"from b_{n}" for n in _BATCH) + "), ps as (select *, coalesce(lag(signal) over (partition by rule, symbol order by ts), 0) * ret as sr from al)")
    + "select rule, symbol, round(product(1 + coalesce(sr, 0)) - 1, 6) as total_return, round(avg(coalesce(sr, 0)) / nullif(stddev_samp(coalesce(sr, 0)), 0) * sqrt(252), 6) as sharpe, count(*) filter (where signal <> 0) as active from ps group by 1, 2")
def _(spark, sf):
    bars = hourly(spark, sf)
    out = None
    for name in _BATCH:
        run = bt.vector_backtest(sig.RULES[name](bars)).withColumn("rule", F.lit(name)).select("rule", "symbol", "strategy_ret", "signal")
        out = run if out is None else out.unionByName(run)
    c = F.col("strategy_ret")
    return out.groupBy("rule", "symbol").agg(r(m.total_return(c)).alias("total_return"), r(m.sharpe(c)).alias("sharpe"), F.count_if(F.col("signal") != 0).alias("active"))
