"""Aggregations of return series, calendar resampling, sorts and set operations."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import windows as win
from ..operators import indicators as ind
from ..operators import metrics as m
from . import sql
from .q_windows import daily, hourly, r, weekly
from .registry import query

S252, S365 = repr(252**0.5), repr(365**0.5)
#: x: the returns there are; p: with equity and drawdown.
PATH = f"""x as (select * from r where ret is not null), p0 as (select *, product(1 + ret) {sql.over('u')} as equity from x),
    p as (select *, equity / max(equity) {sql.over('u')} - 1 as drawdown from p0)"""
TOTAL = "(product(1 + ret) - 1)"
ANNUAL = "case when product(1 + ret) > 0 then pow(product(1 + ret), 252.0 / count(ret)) - 1 end"
SHARPE = f"(avg(ret) - 0.02 / 252) / nullif(stddev_samp(ret), 0) * {S252}"
SORTINO = f"(avg(ret) - 0.02 / 252) / nullif(stddev_samp(case when ret < 0 then ret end), 0) * {S252}"
PF = """case when coalesce(sum(-ret) filter (where ret < 0), 0) = 0 then case when coalesce(sum(ret) filter (where ret > 0), 0) > 0 then 'inf'::double else 0 end
    else coalesce(sum(ret) filter (where ret > 0), 0) / sum(-ret) filter (where ret < 0) end"""
SKEW = sql.skew_pop("ret")


def returns(bars):
    return ind.with_returns(bars)


def rd(df, keys, n=6):
    return df.select(*keys, *[r(F.col(c), n).alias(c) for c in df.columns if c not in keys])


BASIC_SQL = f"""select symbol, round({TOTAL}, 6) as total_return, round({ANNUAL}, 6) as annual_return, round(stddev_samp(ret) * {S252}, 6) as volatility, round({SHARPE}, 6) as sharpe,
    round({SORTINO}, 6) as sortino, round(min(drawdown), 6) as max_drawdown, round(avg((ret > 0)::double), 6) as win_rate, round({PF}, 6) as profit_factor, count(ret) as n,
    round(coalesce(({ANNUAL}) / nullif(abs(min(drawdown)), 0), 0), 6) as calmar from p group by 1"""


@query("agg01_02_04_05_06_08_24_basic_bundle", sql.bars("h", PATH) + BASIC_SQL)
def _(spark, sf):
    return rd(m.performance(returns(hourly(spark, sf))), ["symbol", "n"])


@query("agg29_30_combined_bundle", sql.bars("d", PATH) + f"""select symbol, round({PF}, 6) as profit_factor, round(max(ret), 6) as best_day, round(min(ret), 6) as worst_day, count(*) filter (where ret > 0) as positive_days,
    count(*) filter (where ret < 0) as negative_days, round(avg(ret) * 252, 6) as annual_mean, round(avg((ret > 0)::double), 6) as win_rate, round(min(drawdown), 6) as max_drawdown from p group by 1""")
def _(spark, sf):
    c = F.col("ret")
    p = m.with_path(returns(daily(spark, sf)))
    return p.groupBy("symbol").agg(
        r(m.profit_factor(c)).alias("profit_factor"), r(F.max(c)).alias("best_day"), r(F.min(c)).alias("worst_day"), F.count_if(c > 0).alias("positive_days"),
        F.count_if(c < 0).alias("negative_days"), r(F.avg(c) * 252).alias("annual_mean"), r(m.win_rate(c)).alias("win_rate"), r(F.min("drawdown")).alias("max_drawdown"),
    )


Z95, Z99 = -1.6448536269514722, -2.3263478740408408


@query("agg07_09_10_13_14_17_25_risk_bundle", sql.bars("w", PATH) + f"""select symbol, round(quantile_cont(ret, 0.05), 6) as var_95, round(quantile_cont(ret, 0.01), 6) as var_99,
    round(avg(ret) + {Z95!r} * stddev_pop(ret), 6) as parametric_95, round(avg(ret) + {Z99!r} * stddev_pop(ret), 6) as parametric_99, round({SKEW}, 6) as skewness, round(kurtosis_pop(ret), 6) as kurtosis,
    round(skewness(ret), 6) as skewness_corrected, round(kurtosis(ret), 6) as kurtosis_corrected, round(abs(quantile_cont(ret, 0.95) / quantile_cont(ret, 0.05)), 6) as tail_ratio,
    round(stddev_samp(case when ret < 0 then ret end) * {S252}, 6) as downside, round(sqrt(avg(drawdown * drawdown)), 6) as ulcer, round(avg(drawdown), 6) as pain from p group by 1""")
def _(spark, sf):
    c = F.col("ret")
    p = m.with_path(returns(weekly(spark, sf)))
    return p.groupBy("symbol").agg(
        *[r(x).alias(n) for n, x in {
            "var_95": m.value_at_risk(c, 0.95), "var_99": m.value_at_risk(c, 0.99), "parametric_95": m.parametric_var(c, 0.95), "parametric_99": m.parametric_var(c, 0.99), "skewness": F.skewness(c),
            "kurtosis": F.kurtosis(c), "skewness_corrected": m.skewness_corrected(c), "kurtosis_corrected": m.kurtosis_corrected(c), "tail_ratio": m.tail_ratio(c), "downside": m.downside_deviation(c),
            "ulcer": F.sqrt(F.avg(F.col("drawdown") * F.col("drawdown"))), "pain": F.avg("drawdown"),
        }.items()]
    )


@query("agg03_27_28_simulation_bundle", sql.bars("w", PATH + """, q as (select symbol, quantile_cont(ret, 0.05) as v95, quantile_cont(ret, 0.01) as v99 from x group by 1),
    c as (select symbol, avg(ret) filter (where ret <= v95) as cvar_95, avg(ret) filter (where ret <= v99) as cvar_99 from x join q using (symbol) group by 1)""")
    + f"""select symbol, round({TOTAL}, 6) as cumulative_return, round(case when product(1 + ret) > 0 then pow(product(1 + ret), 1.0 / greatest(count(ret) / 52.0, 1e-6)) - 1 end, 6) as cagr, round(stddev_samp(ret) * {52**.5!r}, 6) as volatility,
    round(avg(ret) / nullif(stddev_samp(ret), 0) * {52**.5!r}, 6) as sharpe, round(avg(ret) * 52 / nullif(sqrt(avg(pow(least(ret, 0), 2))) * {52**.5!r}, 0), 6) as sortino, round(min(drawdown), 6) as max_drawdown,
    round(sqrt(avg(drawdown * drawdown)), 6) as ulcer_index, round({SKEW}, 6) as skewness, round(kurtosis_pop(ret), 6) as kurtosis, round(sum(greatest(ret, 0)) / nullif(sum(greatest(-ret, 0)), 0), 6) as omega,
    round(max(v95), 6) as var_95, round(max(v99), 6) as var_99, round(max(cvar_95), 6) as cvar_95, round(max(cvar_99), 6) as cvar_99,
    round(case when product(1 + ret) > 0 then pow(product(1 + ret), 1.0 / greatest(count(ret) / 52.0, 1e-6)) - 1 end / nullif(abs(min(drawdown)), 0), 6) as calmar from p join q using (symbol) join c using (symbol) group by 1""")
def _(spark, sf):
    return rd(m.simulation_metrics(returns(weekly(spark, sf)), ("symbol",), "ts", 52), ["symbol"])


_LEVELS = [0.9, 0.95, 0.99, 0.999]
_TAILS = " union all ".join(f"select symbol, {x}::double as level, quantile_cont(ret, {1 - x!r}) as var from x group by 1" for x in _LEVELS)
_UNDER = " union all ".join(f"select symbol, {x}::double as level, quantile_cont(drawdown, {1 - x!r}) as dq from p where drawdown < 0 group by 1" for x in _LEVELS)


@query("agg12_38_expected_shortfall_and_drawdown", sql.bars("d", PATH + f""", v as ({_TAILS}), ed as ({_UNDER}),
    dd as (select ed.symbol, ed.level, avg(drawdown) as expected_drawdown from ed join p on p.symbol = ed.symbol and p.drawdown < 0 and p.drawdown <= dq group by 1, 2),
    cv as (select v.symbol, v.level, max(var) as var, avg(ret) as cvar from v join x on x.symbol = v.symbol and ret <= var group by 1, 2)""")
    + "select symbol, level, round(var, 6) as var, round(cvar, 6) as cvar, round(expected_drawdown, 6) as expected_drawdown from cv join dd using (symbol, level)")
def _(spark, sf):
    p = m.with_path(returns(daily(spark, sf)))
    levels = _LEVELS
    tails = m.tail_mean(p, levels)
    under = p.where("drawdown < 0").select("symbol", F.col("drawdown").alias("ret"))
    out = tails.join(m.tail_mean(under, levels).select("symbol", "level", F.col("cvar").alias("expected_drawdown")), ["symbol", "level"])
    return rd(out, ["symbol", "level"])


@query("agg15_16_18_19_20_ratios", sql.bars("w", PATH + ", f as (select symbol, arg_min(equity, ts) as e0, arg_max(equity, ts) as e1 from p group by 1)") + f"""select symbol, round(sum(greatest(ret, 0)) / nullif(sum(greatest(-ret, 0)), 0), 6) as omega, round(sum(ret) filter (where ret > 0) / sum(-ret) filter (where ret < 0), 6) as gain_to_pain,
    round(avg(ret) / nullif(sqrt(sum(drawdown * drawdown)), 0), 6) as burke, round((pow(max(e1) / max(e0), 52.0 / count(*)) - 1) / nullif(abs(avg(drawdown) filter (where drawdown < 0)), 0), 6) as sterling,
    round({TOTAL} * abs(quantile_cont(ret, 0.95) / quantile_cont(ret, 0.05)) / nullif(abs(min(drawdown)), 0), 6) as common_sense from p join f using (symbol) group by 1""")
def _(spark, sf):
    c, d = F.col("ret"), F.col("drawdown")
    p = m.with_path(returns(weekly(spark, sf)))
    growth = F.max_by("equity", "ts") / F.min_by("equity", "ts")
    return p.groupBy("symbol").agg(
        r(m.omega(c)).alias("omega"), r(m.gain_to_pain(c)).alias("gain_to_pain"), r(F.avg(c) / F.nullif(F.sqrt(F.sum(d * d)), F.lit(0.0))).alias("burke"),
        r((F.pow(growth, F.lit(52.0) / F.count("*")) - 1) / F.nullif(F.abs(F.avg(F.when(d < 0, d))), F.lit(0.0))).alias("sterling"),
        r(m.total_return(c) * m.tail_ratio(c) / F.nullif(F.abs(F.min(d)), F.lit(0.0))).alias("common_sense"),
    )


BENCH_SQL = """b as (select ts, avg(ret) as bench from r where ret is not null group by 1), y as (select symbol, ts, ret, bench from r join b using (ts) where ret is not null)"""


def against_mean(df):
    rets = df.where("ret is not null")
    return rets.join(rets.groupBy("ts").agg(F.avg("ret").alias("bench")), "ts")


@query("agg21_22_joi01_benchmark_relative", sql.bars("w", BENCH_SQL) + f"""select symbol, round(covar_samp(ret, bench) / var_pop(bench), 6) as beta, round(stddev_samp(ret - bench) * {S252}, 6) as tracking_error,
    round(avg(ret - bench) / stddev_samp(ret - bench) * {S252}, 6) as information_ratio,
    round(({ANNUAL}) - (0.02 + covar_samp(ret, bench) / var_pop(bench) * (({ANNUAL.replace('ret', 'bench')}) - 0.02)), 6) as alpha from y group by 1""")
def _(spark, sf):
    return rd(m.relative(against_mean(returns(weekly(spark, sf))), ["symbol"]), ["symbol"])


@query("agg23_risk_adjusted_bundle", sql.bars("w", PATH) + f"""select symbol, round((avg(ret) - 0.02 / 252) / nullif(stddev_pop(ret), 0) * {S252}, 6) as sharpe, round((avg(ret) - 0.02 / 252) / nullif(stddev_pop(case when ret < 0 then ret end), 0) * {S252}, 6) as sortino,
    round(avg(ret) * 252 / nullif(abs(min(drawdown)), 0), 6) as calmar, round((avg(ret) - 0.02 / 252) * 252, 6) as treynor, round(avg(ret) / nullif(stddev_pop(ret), 0) * {S252}, 6) as information_ratio from p group by 1""")
def _(spark, sf):
    c = F.col("ret")
    excess = F.avg(c) - 0.02 / 252
    p = m.with_path(returns(weekly(spark, sf)))
    return p.groupBy("symbol").agg(
        r(m.sharpe(c, 252, 0.02, population=True)).alias("sharpe"), r(excess / F.nullif(F.stddev_pop(F.when(c < 0, c)), F.lit(0.0)) * math.sqrt(252)).alias("sortino"),
        r(F.avg(c) * 252 / F.nullif(F.abs(F.min("drawdown")), F.lit(0.0))).alias("calmar"), r(excess * 252).alias("treynor"), r(m.sharpe(c, 252, 0.0, population=True)).alias("information_ratio"),
    )


@query("agg32_33_srt01_srt02_compare_and_rank", sql.bars("d", PATH) + f"select symbol, round({SHARPE}, 6) as sharpe, round(min(drawdown), 6) as max_drawdown, row_number() over (order by {SHARPE} desc, symbol) as by_sharpe, row_number() over (order by min(drawdown), symbol) as by_drawdown from p group by 1 order by by_sharpe")
def _(spark, sf):
    out = m.performance(returns(daily(spark, sf)))
    rank = lambda *o: F.row_number().over(win.Window.orderBy(*o)).cast("long")  # noqa: E731  a row for each strategy
    return out.select("symbol", r(F.col("sharpe")).alias("sharpe"), r(F.col("max_drawdown")).alias("max_drawdown"), rank(F.desc("sharpe"), "symbol").alias("by_sharpe"), rank("max_drawdown", "symbol").alias("by_drawdown")).orderBy("by_sharpe")


@query("agg34_srt04_across_symbols", sql.bars("h", PATH + f", g as (select symbol, {TOTAL} as total, {SHARPE} as sharpe from x group by 1)") + "select round(avg(total), 6) as mean_return, round(stddev_pop(total), 6) as std_return, round(avg(sharpe), 6) as mean_sharpe, arg_max(symbol, total) as best, arg_min(symbol, total) as worst from g")
def _(spark, sf):
    g = m.performance(returns(hourly(spark, sf)))
    return g.agg(r(F.avg("total_return")).alias("mean_return"), r(F.stddev_pop("total_return")).alias("std_return"), r(F.avg("sharpe")).alias("mean_sharpe"), F.max_by("symbol", "total_return").alias("best"), F.min_by("symbol", "total_return").alias("worst"))


@query("agg35_hill_tail_index", sql.bars("d", PATH + """, k0 as (select symbol, -ret as loss, row_number() over (partition by symbol order by ret) as k, greatest(floor(count(*) over (partition by symbol) * 0.1), 10) as top from x), k1 as (select *, min(loss) over (partition by symbol) as kth from k0 where k <= top)""")
    + "select symbol, cast(max(top) as bigint) as k, round(case when min(loss) > 0 then 1 / avg(ln(loss / kth)) filter (where k < top) end, 6) as tail_index from k1 group by 1")
def _(spark, sf):
    return rd(m.hill_index(returns(daily(spark, sf))), ["symbol", "k"])


@query("agg36_covariance_matrix", sql.bars("w") + "select a.symbol as i, b.symbol as j, round(covar_samp(a.ret, b.ret) * 252, 6) as cov, round(corr(a.ret, b.ret), 6) as corr from r a join r b on a.ts = b.ts and a.symbol <= b.symbol where a.ret is not null and b.ret is not null group by 1, 2")
def _(spark, sf):
    return rd(m.covariance(returns(weekly(spark, sf))), ["i", "j"])


@query("agg40_validity_flags", sql.bars("d", PATH) + f"""select symbol, list_sort(list_filter([case when {TOTAL} > 100 then 'total_return' end, case when {SHARPE.replace('0.02', '0.0')} > 10 then 'sharpe' end, case when avg((ret > 0)::double) > 0.8 then 'win_rate' end,
    case when stddev_samp(ret) = 0 then 'no_volatility' end, case when max(ret) > 0.5 then 'max_day' end], lambda x: x is not null))::varchar as flags from p group by 1""")
def _(spark, sf):
    c = F.col("ret")
    flags = {"total_return": m.total_return(c) > 100, "sharpe": m.sharpe(c) > 10, "win_rate": m.win_rate(c) > 0.8, "no_volatility": F.stddev_samp(c) == 0, "max_day": F.max(c) > 0.5}
    found = F.array_sort(F.filter(F.array(*[F.when(p, n) for n, p in flags.items()]), lambda x: x.isNotNull()))
    out = m.with_path(returns(daily(spark, sf))).groupBy("symbol").agg(found.alias("f"))
    return out.select("symbol", F.concat(F.lit("["), F.array_join("f", ", "), F.lit("]")).alias("flags"))


def _period_sql(unit):
    return f"select symbol, date_trunc('{unit}', ts)::timestamp as period, product(1 + ret) - 1 as ret, count(*) as n from x group by 1, 2"


@query("rsm01_compound_weekly", sql.bars("d", PATH) + f"select symbol, period, period + interval 6 day as label, n, round(ret, 6) as ret from ({_period_sql('week')})")
def _(spark, sf):
    c = m.compound(returns(daily(spark, sf)), "week")
    return c.select("symbol", "period", (F.col("period") + F.expr("interval 6 days")).alias("label"), "n", r(F.col("ret")).alias("ret"))


_PERIODS = {"month": "month", "quarter": "quarter", "year": "year"}


@query("rsm02_periods_best_worst", sql.bars("d", PATH) + " union all ".join(f"select symbol, '{u}' as unit, round(max(ret), 6) as best, round(min(ret), 6) as worst, count(*) filter (where ret > 0) as positive, count(*) as total, round(count(*) filter (where ret > 0) / count(*), 6) as win_rate from ({_period_sql(u)}) group by 1" for u in _PERIODS))
def _(spark, sf):
    rets = returns(daily(spark, sf))
    out = None
    for u in _PERIODS:
        c = F.col("ret")
        part = m.compound(rets, u).groupBy("symbol").agg(r(F.max(c)).alias("best"), r(F.min(c)).alias("worst"), F.count_if(c > 0).alias("positive"), F.count("*").alias("total"), r(F.count_if(c > 0) / F.count("*")).alias("win_rate"))
        part = part.select("symbol", F.lit(u).alias("unit"), "best", "worst", "positive", "total", "win_rate")
        out = part if out is None else out.unionByName(part)
    return out


@query("rsh04_viz04_monthly_matrix", sql.bars("d", PATH + f", c as ({_period_sql('month')})") + "select symbol, cast(year(period) as int) as year, " + ", ".join(f"round(max(ret) filter (where month(period) = {k}), 6) as m{k:02d}" for k in range(1, 13)) + " from c group by 1, 2")
def _(spark, sf):
    c = m.compound(returns(daily(spark, sf)), "month").withColumns({"year": F.year("period"), "month": F.month("period")})
    wide = c.groupBy("symbol", "year").pivot("month", list(range(1, 13))).agg(F.first("ret"))
    return wide.select("symbol", "year", *[r(F.col(str(k))).alias(f"m{k:02d}") for k in range(1, 13)])


@query("flt01_02_03_filters", sql.bars("d") + "select symbol, count(*) as n, count(*) filter (where ret < 0) as losses, round(avg(ret) filter (where ret > 0), 6) as mean_gain from r where ts between timestamp '1996-01-01' and timestamp '1997-12-31' and symbol in ('A', 'R') and ret <> 0 group by 1")
def _(spark, sf):
    ts = F.col("ts").between(F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1997-12-31").cast("timestamp_ntz"))
    c = F.col("ret")
    return returns(daily(spark, sf)).where(ts & F.col("symbol").isin("A", "R") & (c != 0)).groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(c < 0).alias("losses"), r(F.avg(F.when(c > 0, c))).alias("mean_gain"))


SPLIT_SQL = "s as (select *, case when t < floor(n * 0.7::double) then 'train' when t < floor(n * 0.85::double) then 'validation' else 'test' end as split from (select *, count(*) over (partition by symbol) as n from r))"


def split(df, train: float = 0.7, validation: float = 0.85):
    """Chronological parts of each symbol, by ordinal."""
    n = F.count("*").over(win.Window.partitionBy("symbol"))
    return df.withColumn("_n", n).withColumn("split", F.when(F.col("t") < F.floor(F.col("_n") * train), "train").when(F.col("t") < F.floor(F.col("_n") * validation), "validation").otherwise("test")).drop("_n")


@query("flt04_set01_split_and_union", sql.bars("h", SPLIT_SQL) + "select symbol, split, count(*) as n, min(ts) as first_ts, max(ts) as last_ts, round(avg(ret), 6) as mean from s group by 1, 2 union all select symbol, 'all', count(*), min(ts), max(ts), round(avg(ret), 6) from s group by 1")
def _(spark, sf):
    s = split(returns(hourly(spark, sf)))
    agg = [F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), r(F.avg("ret")).alias("mean")]
    return s.groupBy("symbol", "split").agg(*agg).unionByName(s.groupBy("symbol").agg(*agg).withColumn("split", F.lit("all")))


@query("rsh01_dedupe_first", "select user_id, event_id, event_type, round(value, 6) as value from (select *, row_number() over (partition by user_id order by ts, event_id) as k from events) where k = 1")
def _(spark, sf):
    from ..sources.bars import keep_first, table

    return keep_first(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", r(F.col("value")).alias("value"))


@query("rsh02_03_forward_fill", sql.bars("h", "g as (select symbol, unnest(generate_series(min(ts), max(ts), interval 1 hour)) as ts from bars group by symbol), f as (select g.symbol, g.ts, b.close from g left join bars b using (symbol, ts))")
    + "select symbol, ts, round(last_value(close ignore nulls) over (partition by symbol order by ts rows unbounded preceding), 6) as filled, round(coalesce(close, 0), 6) as zeroed from f")
def _(spark, sf):
    bars = hourly(spark, sf)
    ends = bars.groupBy("symbol").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    grid = ends.select("symbol", F.explode(F.sequence("lo", "hi", F.expr("interval 1 hour"))).alias("ts"))  # a row for each hour of a symbol's bars
    f = grid.join(bars.select("symbol", "ts", "close"), ["symbol", "ts"], "left")
    return f.select("symbol", "ts", r(win.forward_fill("close")).alias("filled"), r(F.coalesce("close", F.lit(0.0))).alias("zeroed"))


@query("joi_asof_trades_to_bars", """with q as (select event_id, ts, user_id, value from events where event_type = 'purchase'), v as (select user_id, ts as vts, event_id as vid from events where event_type = 'view')
    select q.event_id, (select max(vts) from v where v.user_id = q.user_id and v.vts <= q.ts) as last_view from q""")
def _(spark, sf):
    from ..operators.joins import asof
    from ..sources.bars import table

    e = table(spark, sf, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "ts", "user_id")
    right = e.where("event_type = 'view'").select("user_id", "ts", F.col("ts").alias("last_view"))
    return asof(left, right, ["user_id"], "ts", ["last_view"]).select("event_id", "last_view")


@query("joi03_positional_pairing", sql.bars("w") + "select a.t as t, round(a.ret, 6) as ra, round(b.ret, 6) as rb from r a join r b on a.t = b.t and a.symbol = 'A' and b.symbol = 'N' where a.ret is not null and b.ret is not null")
def _(spark, sf):
    from ..operators.joins import positional

    rets = returns(weekly(spark, sf)).withColumn("t", F.col("t").cast("long"))
    return positional(rets.where("symbol = 'A'").select("t", F.col("ret").alias("ra")), rets.where("symbol = 'N'").select("t", F.col("ret").alias("rb")), "t").na.drop().select("t", r(F.col("ra")).alias("ra"), r(F.col("rb")).alias("rb"))


@query("joi05_parameter_grid_sma", sql.bars("h", "g as (select unnest([5, 10, 20]) as n), k as (select unnest([0.01, 0.02]) as th), x as (select symbol, ts, close, " + ", ".join(f"{sql.sma('close', n)} as s{n}" for n in (5, 10, 20)) + " from r), y as (select symbol, n, th, close / (case n when 5 then s5 when 10 then s10 else s20 end) - 1 as dev from x, g, k)")
    + "select symbol, cast(n as int) as n, cast(th as double) as threshold, count(*) filter (where dev > th) as above, count(*) filter (where dev < -th) as below from y group by 1, 2, 3")
def _(spark, sf):
    from ..operators.optimize import grid

    params = grid(spark, {"n": [5, 10, 20], "threshold": [0.01, 0.02]})
    bars = hourly(spark, sf)
    wide = bars.withColumns({f"s{n}": win.sma("close", n) for n in (5, 10, 20)})
    pick = F.when(F.col("n") == 5, F.col("s5")).when(F.col("n") == 10, F.col("s10")).otherwise(F.col("s20"))
    dev = F.col("close") / F.nullif(pick, F.lit(0.0)) - 1
    return wide.crossJoin(F.broadcast(params)).groupBy("symbol", "n", "threshold").agg(F.count_if(dev > F.col("threshold")).alias("above"), F.count_if(dev < -F.col("threshold")).alias("below"))
