"""Bars, projections, filters, joins, window indicators."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import windows as win
from ..operators import indicators as ind
from ..sources import bars as src
from . import sql
from .registry import query


def r(c, n: int = 6):
    return F.round(c, n)


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    return src.event_bars(src.table(spark, sf, "events"))


def daily(spark: SparkSession, sf: str) -> DataFrame:
    return src.line_bars(src.table(spark, sf, "lineitem"), "day")


def weekly(spark: SparkSession, sf: str) -> DataFrame:
    return src.line_bars(src.table(spark, sf, "lineitem"), "week")


def damped(bars: DataFrame) -> DataFrame:
    """The bars with moves like those of prices; the test tables hold noise, which would use up any account."""
    return bars.withColumns({c: F.pow(F.col(c), F.lit(0.02)) * 100 for c in ("open", "high", "low", "close")})


def damped_hourly(spark: SparkSession, sf: str) -> DataFrame:
    return damped(hourly(spark, sf))


def damped_weekly(spark: SparkSession, sf: str) -> DataFrame:
    return damped(weekly(spark, sf))


def rounded(df: DataFrame, keys: list[str], values: list[str], n: int = 6) -> DataFrame:
    return df.select(*keys, *[r(F.col(v), n).alias(v) for v in values])


def rounded_sql(keys: list[str], values: dict[str, str], n: int = 6) -> str:
    return ", ".join([*keys, *[f"round({e}, {n}) as {v}" for v, e in values.items()]])


_OHLCV = ["open", "high", "low", "close", "volume"]


@query("rsm03_bars_hourly", sql.bars("h") + f"select {rounded_sql(['symbol', 'ts'], {c: c for c in _OHLCV})} from bars")
def _(spark, sf):
    return rounded(hourly(spark, sf), ["symbol", "ts"], _OHLCV)


@query("rsm03_bars_daily", sql.bars("d") + f"select {rounded_sql(['symbol', 'ts'], {c: c for c in _OHLCV})} from bars")
def _(spark, sf):
    return rounded(daily(spark, sf), ["symbol", "ts"], _OHLCV)


@query("rsm03_bars_weekly", sql.bars("w") + f"select {rounded_sql(['symbol', 'ts'], {c: c for c in _OHLCV})} from bars")
def _(spark, sf):
    return rounded(weekly(spark, sf), ["symbol", "ts"], _OHLCV)


@query(
    "prj02_03_04_rsh05_06_returns",
    sql.bars("d") + f"select {rounded_sql(['symbol', 'ts', 't'], {'ret': 'ret', 'log_ret': 'log_ret', 'log1p_ret': 'ln(1 + ret)', 'hl_ratio': '(high - low) / close', 'diff': 'd', 'prev': 'lag(close) over (partition by symbol order by ts)'})} from r",
)
def _(spark, sf):
    df = ind.with_returns(daily(spark, sf)).withColumns(
        {"log1p_ret": F.log1p("ret"), "hl_ratio": (F.col("high") - F.col("low")) / F.col("close"), "diff": win.difference(), "prev": win.lag("close")}
    )
    return rounded(df.withColumn("t", F.col("t").cast("long")), ["symbol", "ts", "t"], ["ret", "log_ret", "log1p_ret", "hl_ratio", "diff", "prev"])


def ema_sql(x: str, n: int, source: str = "r") -> str:
    """(symbol, ts, ema{n}) by joining each row to those before it."""
    decay, k = 1 - 2 / (n + 1), win.ema_span(n)
    return f"""select a.symbol, a.ts, sum(b.{x} * pow({decay!r}, a.t - b.t)) / sum(pow({decay!r}, a.t - b.t)) as ema{n}
        from {source} a join {source} b on a.symbol = b.symbol and b.t between a.t - {k} and a.t group by 1, 2"""


_ENRICHED = {
    "sma10": sql.sma("close", 10), "sma20": sql.sma("close", 20), "sma50": sql.sma("close", 50), "vol20": sql.std("ret", 20),
    "volume_sma20": sql.sma("volume", 20), "volume_ratio": f"volume / nullif({sql.sma('volume', 20)}, 0)", "hl_ratio": "(high - low) / close",
}


@query(
    "prj05_win01_02_03_enrich",
    sql.bars("h", f"e10 as ({ema_sql('close', 10)}), e20 as ({ema_sql('close', 20)}), x as (select symbol, ts, t, ret, log_ret, {', '.join(f'{e} as {v}' for v, e in _ENRICHED.items())} from r)")
    + f"select {rounded_sql(['symbol', 'ts'], {v: v for v in ['ret', 'log_ret', *_ENRICHED, 'ema10', 'ema20']})} from x join e10 using (symbol, ts) join e20 using (symbol, ts) where t >= 30",
)
def _(spark, sf):
    return rounded(ind.enrich(hourly(spark, sf), lookback=30), ["symbol", "ts"], ["ret", "log_ret", *_ENRICHED, "ema10", "ema20"])


_WINDOW_DD = """p as (select a.symbol, a.ts, b.ts as s, product(1 + b.ret) over (partition by a.symbol, a.ts order by b.ts) as eq
        from r a join r b on a.symbol = b.symbol and b.t between a.t - 62 and a.t where a.t >= 63),
    q as (select *, max(eq) over (partition by symbol, ts order by s) as peak from p),
    dd as (select symbol, ts, least(0, min(eq / peak - 1)) as rolling_max_drawdown from q group by 1, 2)"""
_SHARPE63 = f"case when {sql.std('ret', 63)} = 0 then 0 else {sql.sma('ret', 63)} / {sql.std('ret', 63)} * {252**0.5!r} end"


@query(
    "win04_05_06_07_rolling_metrics",
    sql.bars("d", f"x as (select symbol, ts, {_SHARPE63} as rolling_sharpe, {sql.std('ret', 63)} * {252**0.5!r} as rolling_volatility from r), {_WINDOW_DD}")
    + f"select {rounded_sql(['symbol', 'ts'], {v: v for v in ['rolling_sharpe', 'rolling_volatility', 'rolling_max_drawdown']})} from x left join dd using (symbol, ts)",
)
def _(spark, sf):
    df = ind.rolling_metrics(ind.with_returns(daily(spark, sf)), 63, 252)
    return rounded(df, ["symbol", "ts"], ["rolling_sharpe", "rolling_volatility", "rolling_max_drawdown"])


_MOMENTS = """m as (select a.symbol, a.ts, count(*) as n, quantile_cont(b.ret, 0.05) as q, stddev_pop(b.ret) as sd, avg(b.ret) as mu, list(b.ret) as l
        from r a join r b on a.symbol = b.symbol and b.t between a.t - 62 and a.t where a.t >= 63 group by 1, 2)"""


@query(
    "win08_rolling_risk",
    sql.bars("w", _MOMENTS)
    + """select symbol, ts, round(q, 6) as rolling_var, round(list_avg(list_filter(l, lambda x: x <= q)), 6) as rolling_es, round(sd, 6) as rolling_volatility,
        round(list_avg(list_transform(l, lambda x: pow(x - mu, 3))) / pow(sd, 3), 6) as rolling_skewness,
        round(list_avg(list_transform(l, lambda x: pow(x - mu, 4))) / pow(sd, 4) - 3, 6) as rolling_kurtosis from m""",
)
def _(spark, sf):
    df = ind.rolling_risk(ind.with_returns(weekly(spark, sf)), 63).where("rolling_var is not null")
    return rounded(df, ["symbol", "ts"], ["rolling_var", "rolling_es", "rolling_volatility", "rolling_skewness", "rolling_kurtosis"])


EQUITY_SQL = f"e as (select *, product(1 + coalesce(ret, 0)) {sql.over('u')} as equity from r)"
DD_SQL = f"""{EQUITY_SQL}, pk as (select *, max(equity) {sql.over('u')} as peak from e),
    dd as (select *, equity / peak - 1 as drawdown from pk), isl as (select *, sum((drawdown >= 0)::bigint) {sql.over('u')} as island from dd)"""


def equity_of(df: DataFrame) -> DataFrame:
    return ind.with_returns(df).withColumn("equity", win.running_equity("ret"))


@query(
    "win09_10_11_drawdown_series",
    sql.bars("d", DD_SQL) + f"select {rounded_sql(['symbol', 'ts'], {v: v for v in ['equity', 'peak', 'drawdown']})} from dd",
)
def _(spark, sf):
    return rounded(ind.drawdowns(equity_of(daily(spark, sf))), ["symbol", "ts"], ["equity", "peak", "drawdown"])


@query(
    "win12_13_14_ulcer_pain_duration",
    sql.bars("d", DD_SQL + ", runs as (select symbol, island, count(*) as n from isl where drawdown < 0 group by 1, 2), longest as (select symbol, max(n) as max_duration from runs group by 1)")
    + """select symbol, round(sqrt(avg(drawdown * drawdown)), 6) as ulcer, round(avg(drawdown), 6) as pain_signed, round(avg(abs(drawdown)), 6) as pain_abs,
        round(min(drawdown), 6) as max_drawdown, max(coalesce(max_duration, 0)) as max_duration from dd left join longest using (symbol) group by 1""",
)
def _(spark, sf):
    dd = ind.drawdowns(equity_of(daily(spark, sf)))
    runs = dd.where("drawdown < 0").groupBy("symbol", "island").count().groupBy("symbol").agg(F.max("count").alias("max_duration"))
    d = F.col("drawdown")
    out = dd.groupBy("symbol").agg(
        r(F.sqrt(F.avg(d * d))).alias("ulcer"), r(F.avg(d)).alias("pain_signed"), r(F.avg(F.abs(d))).alias("pain_abs"), r(F.min(d)).alias("max_drawdown")
    )
    return out.join(runs, "symbol", "left").withColumn("max_duration", F.coalesce("max_duration", F.lit(0)))


@query(
    "win15_drawdown_durations",
    sql.bars("d", DD_SQL + f", y as (select *, sum((drawdown >= -1e-6)::bigint) {sql.over('u')} as isle from dd), runs as (select symbol, isle, count(*) as n from y where drawdown < -1e-6 group by 1, 2), bars_n as (select symbol, count(*) as total from dd group by 1)")
    + """select symbol, count(*) as periods, round(avg(n), 6) as avg_duration, max(n) as max_duration, round(quantile_cont(n, 0.5), 6) as median_duration,
        cast(sum(n) as bigint) as total_duration, round(100.0 * sum(n) / max(total), 6) as percent_under from runs join bars_n using (symbol) group by 1""",
)
def _(spark, sf):
    dd = ind.drawdowns(equity_of(daily(spark, sf)))
    isle = F.sum((F.col("drawdown") >= -1e-6).cast("long")).over(win.upto())
    runs = dd.withColumn("isle", isle).where("drawdown < -1e-6").groupBy("symbol", "isle").agg(F.count("*").alias("n"))
    total = dd.groupBy("symbol").agg(F.count("*").alias("total"))
    out = runs.join(total, "symbol").groupBy("symbol").agg(
        F.count("*").alias("periods"), r(F.avg("n")).alias("avg_duration"), F.max("n").alias("max_duration"), r(F.percentile("n", F.lit(0.5))).alias("median_duration"),
        F.sum("n").alias("total_duration"), r(F.sum("n") * 100.0 / F.max("total")).alias("percent_under"),
    )
    return out


@query(
    "win16_drawdown_periods",
    sql.bars("d", DD_SQL + f", nx as (select *, lead(ts) over (partition by symbol order by ts) as nxt from isl)")
    + """select symbol, min(ts) as "start", max(ts) as "end", count(*) as bars, date_diff('day', min(ts), max(ts)) as days, round(min(drawdown), 6) as magnitude, round(max(peak), 6) as peak_value,
        round(min(equity), 6) as trough_value, arg_max(nxt is not null, ts) as recovered from nx where drawdown < 0 group by symbol, island""",
)
def _(spark, sf):
    p = ind.drawdown_periods(equity_of(daily(spark, sf)))
    return p.select("symbol", "start", "end", "bars", F.datediff("end", "start").cast("long").alias("days"), *[r(c).alias(c) for c in ("magnitude", "peak_value", "trough_value")], "recovered")


@query(
    "win17_streaks",
    sql.bars("d", """s as (select symbol, ts, sign(ret) as s from r where ret is not null), c as (select *, (s <> coalesce(lag(s) over (partition by symbol order by ts), 9))::bigint as n from s),
        g as (select *, sum(n) over (partition by symbol order by ts rows unbounded preceding) as run from c), k as (select symbol, run, s, count(*) as len from g group by 1, 2, 3)""")
    + "select symbol, coalesce(max(len) filter (where s = 1), 0) as max_wins, coalesce(max(len) filter (where s = -1), 0) as max_losses from k group by 1",
)
def _(spark, sf):
    return ind.streaks(ind.with_returns(daily(spark, sf)))


@query(
    "win18_regime_by_volatility",
    sql.bars("d", f"v as (select *, {sql.std('ret', 21)} * {252**0.5!r} as vol from r), m as (select symbol, quantile_cont(vol, 0.5) as cut from v group by 1)")
    + "select symbol, case when vol > cut then 'high' else 'low' end as regime, count(*) as n, round(avg(ret) * 252, 6) as mean, round(stddev_samp(ret) * sqrt(252), 6) as volatility, round(min(ret), 6) as worst from v join m using (symbol) where vol is not null group by 1, 2",
)
def _(spark, sf):
    v = ind.with_returns(daily(spark, sf)).withColumn("vol", win.std("ret", 21) * math.sqrt(252))
    cut = v.groupBy("symbol").agg(F.percentile("vol", F.lit(0.5)).alias("cut"))
    out = v.join(cut, "symbol").where("vol is not null").withColumn("regime", F.when(F.col("vol") > F.col("cut"), "high").otherwise("low"))
    return out.groupBy("symbol", "regime").agg(
        F.count("*").alias("n"), r(F.avg("ret") * 252).alias("mean"), r(F.stddev_samp("ret") * math.sqrt(252)).alias("volatility"), r(F.min("ret")).alias("worst")
    )


@query(
    "win19_volatility_quantile_regimes",
    sql.bars("d", f"v as (select *, {sql.std('ret', 21)} as vol from r), m as (select symbol, quantile_cont(vol, 0.3) as lo, quantile_cont(vol, 0.7) as hi from v group by 1)")
    + """select symbol, round(avg(ret) filter (where vol > hi), 6) as high_vol_mean, round(avg(ret) filter (where vol < lo), 6) as low_vol_mean, round(avg(ret) filter (where ret > 0), 6) as bull_mean,
        round(avg(ret) filter (where ret < 0), 6) as bear_mean from v join m using (symbol) group by 1""",
)
def _(spark, sf):
    v = ind.with_returns(daily(spark, sf)).withColumn("vol", win.std("ret", 21))
    cut = v.groupBy("symbol").agg(F.percentile("vol", F.lit(0.3)).alias("lo"), F.percentile("vol", F.lit(0.7)).alias("hi"))
    mean = lambda p: r(F.avg(F.when(p, F.col("ret"))))
    c = F.col
    return v.join(cut, "symbol").groupBy("symbol").agg(
        mean(c("vol") > c("hi")).alias("high_vol_mean"), mean(c("vol") < c("lo")).alias("low_vol_mean"), mean(c("ret") > 0).alias("bull_mean"), mean(c("ret") < 0).alias("bear_mean")
    )


_Q = [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]


@query(
    "win20_risk_return_profile",
    sql.bars("d", f"v as (select *, {sql.std('ret', 60)} * {252**0.5!r} as vol, {_SHARPE63.replace('63', '60').replace('62', '59')} as sharpe from r)")
    + f"""select symbol, {', '.join(f"round({a}({c}), 6) as {c}_{n}" for c in ("vol", "sharpe") for n, a in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")))},
        {', '.join(f"round(quantile_cont(ret, {q}), 6) as q{int(q * 100):02d}" for q in _Q)} from v group by 1""",
)
def _(spark, sf):
    v = ind.with_returns(daily(spark, sf)).withColumns({"vol": win.std("ret", 60) * math.sqrt(252), "sharpe": win.rolling_sharpe("ret", 60, 252)})
    out = v.groupBy("symbol").agg(
        *[r(a(c)).alias(f"{c}_{n}") for c in ("vol", "sharpe") for n, a in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))],
        F.percentile("ret", F.array(*map(F.lit, _Q))).alias("q"),
    )
    return out.select("*", *[r(F.col("q")[i]).alias(f"q{int(q * 100):02d}") for i, q in enumerate(_Q)]).drop("q")


RSI_SQL = """rs as (select *, case when count(d) {o} < {n} then 50 when avg(greatest(-d, 0)) {o} = 0 then 100
        else 100 - 100 / (1 + avg(case when d is not null then greatest(d, 0) end) {o} / avg(case when d is not null then greatest(-d, 0) end) {o}) end as rsi from r)""".replace("{o}", sql.over(-13)).replace("{n}", "14")
TR_SQL = f"""tr as (select *, lag(close) over w as before, high - lag(high) over w as up, lag(low) over w - low as down from r window w as (partition by symbol order by ts)),
    tr2 as (select *, case when before is not null then greatest(high - low, abs(high - before), abs(low - before)) end as trv, case when up is not null then case when up > down and up > 0 then up else 0 end end as plus,
        case when up is not null then case when down > up and down > 0 then down else 0 end end as minus from tr),
    ax as (select *, {sql.sma('trv', 14)} as a, {sql.sma('plus', 14)} as p, {sql.sma('minus', 14)} as m from tr2)"""
ADX_SQL = "coalesce(abs(p / nullif(a, 0) - m / nullif(a, 0)) / nullif(p / nullif(a, 0) + m / nullif(a, 0), 0) * 100, 25)"


@query(
    "win21_22_23_24_rsi_atr_adx_bollinger",
    sql.bars("h", RSI_SQL + ", " + TR_SQL)
    + f"""select ax.symbol, ax.ts, round(rsi, 6) as rsi, round(coalesce(a, ax.high - ax.low), 6) as atr, round({ADX_SQL}, 6) as adx, round(bb_mid, 6) as bb_mid, round(bb_mid + 2 * sd, 6) as bb_upper, round(bb_mid - 2 * sd, 6) as bb_lower
        from ax join rs using (symbol, ts) join (select symbol, ts, {sql.sma('close', 20)} as bb_mid, {sql.std('close', 20)} as sd from r) using (symbol, ts)""",
)
def _(spark, sf):
    df = ind.bollinger(ind.adx(ind.atr(ind.rsi(hourly(spark, sf)))))
    return rounded(df, ["symbol", "ts"], ["rsi", "atr", "adx", "bb_mid", "bb_upper", "bb_lower"])


_Z = {
    "z_prior": f"(close - {sql.full('avg', 'close', 60, -60, -1)}) / nullif({sql.full('stddev_samp', 'close', 60, -60, -1)}, 0)",
    "z_incl": f"(close - {sql.full('avg', 'close', 31, -30)}) / nullif({sql.full('stddev_samp', 'close', 31, -30)}, 0)",
    "highest": sql.full("max", "high", 20, -20, -1),
    "lowest": sql.full("min", "low", 20, -20, -1),
    "volume_ratio": f"volume / nullif({sql.full('avg', 'volume', 20, -20, -1)}, 0)",
}


@query("win25_26_29_30_zscores_channels_volume", sql.bars("h") + f"select {rounded_sql(['symbol', 'ts'], _Z)}, coalesce({_Z["volume_ratio"]} >= 1.5, false) as volume_confirmed from r")
def _(spark, sf):
    hi, lo = win.channel(20)
    ratio = win.volume_ratio(20)
    df = hourly(spark, sf).withColumns({"z_prior": win.zscore_prior("close", 60), "z_incl": win.zscore("close", 31), "highest": hi, "lowest": lo, "volume_ratio": ratio})
    return rounded(df.withColumn("volume_confirmed", F.coalesce(F.col("volume_ratio") >= 1.5, F.lit(False))), ["symbol", "ts", "volume_confirmed"], list(_Z))


PAIR_SQL = """pr as (select 'A/N' as symbol, ts, max(case when symbol = 'A' then close end) as a, max(case when symbol = 'N' then close end) as b from bars where symbol in ('A', 'N') group by ts having count(*) = 2),
    h as (select *, case when count(*) {o} = 60 then regr_slope(ln(a), ln(b)) {o} else 1 end as hedge from pr), sp as (select *, ln(a) - hedge * ln(b) as spread, a / lag(a) over (order by ts) - 1 as ra, b / lag(b) over (order by ts) - 1 as rb, row_number() over (order by ts) - 1 as t from h)""".replace("{o}", sql.over(-59))


def pair(spark: SparkSession, sf: str) -> DataFrame:
    return pair_of(weekly(spark, sf))


def pair_of(bars: DataFrame) -> DataFrame:
    wide = src.aligned(bars, ["A", "N"])
    return wide.select(F.lit("A/N").alias("symbol"), "ts", F.col("A").alias("a"), F.col("N").alias("b"))


_PAIR = {
    "hedge": "hedge", "spread": "spread", "z_spread": f"case when t >= 119 then (spread - avg(spread) {sql.over(-59)}) / nullif(stddev_pop(spread) {sql.over(-59)}, 0) end",
    "var_a": sql.full("var_samp", "ra", 30, -30, -1), "corr_ab": f"(case when count(ra) {sql.over(-30, -1)} = 30 then corr(ra, rb) {sql.over(-30, -1)} end)",
}


@query("win27_28_31_joi02_src04_pair_windows", sql.bars("w", PAIR_SQL) + f"select {rounded_sql(['ts'], _PAIR)} from sp")
def _(spark, sf):
    p = ind.hedge_ratio(pair(spark, sf), "a", "b", 60).withColumns({"ra": win.simple_return("a"), "rb": win.simple_return("b"), "t": F.row_number().over(win.spec()) - 1})
    before = win.rows(-30, -1)
    p = p.withColumns(
        {
            "z_spread": F.when(F.col("t") >= 119, win.zscore("spread", 60, F.stddev_pop)),
            "var_a": win.full(F.col("ra"), 30, F.var_samp, -30, -1),
            "corr_ab": F.when(F.count("ra").over(before) == 30, F.corr("ra", "rb").over(before)),
        }
    )
    return rounded(p, ["ts"], list(_PAIR))
