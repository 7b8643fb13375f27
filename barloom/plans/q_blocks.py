"""One series over many tasks: prefix scans, windows in blocks, exact quantiles and ranks of groups that no task holds.

The blocks and limits are small here, so that the test tables make many of them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import windows as win
from ..operators import backtest as bt
from ..operators import blocks as bl
from ..operators import indicators as ind
from ..operators import quantiles as qs
from ..operators import ranks as rk
from ..operators import signals as sig
from ..sources import bars as src
from . import sql
from .q_metrics import rd
from .q_resample import _HALVES, SERIES, series
from .q_signals import VECTOR
from .q_windows import ema_sql, hourly, rounded
from .registry import query

ROWS = 512

#: Every event is a tick of one series, its moves damped to those of prices.
_TICKS = """with k as (select 'all' as symbol, ts, 100 * pow(value, 0.02) as close from events where value > 0),
    r as (select *, row_number() over (order by ts) - 1 as t, close / lag(close) over (order by ts) - 1 as ret from k) """


def ticks(spark, sf):
    """One symbol, one row for each event with a value, with the return from the event before it."""
    e = src.table(spark, sf, "events").where("value > 0")
    one = e.select(F.lit("all").alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("ts"), (F.pow("value", F.lit(0.02)) * 100).alias("close"))
    return bl.in_blocks(one, 1, lambda df, w: df.withColumn("ret", win.simple_return("close", 1, w)), rows=ROWS)


@query(
    "win09_10_11_one_series_in_blocks",
    _TICKS + ", e as (select *, product(1 + coalesce(ret, 0)) over (order by t) as equity from r), p as (select *, max(equity) over (order by t) as peak from e) select symbol, ts, round(equity, 8) as equity, round(peak, 8) as peak, round(equity / peak - 1, 8) as drawdown from p",
)
def _(spark, sf):
    return rounded(bl.equity_path(ticks(spark, sf), rows=ROWS), ["symbol", "ts"], ["equity", "peak", "drawdown"], 8)


@query(
    "win03_ema_in_blocks",
    _TICKS + f", e10 as ({ema_sql('close', 10)}), e20 as ({ema_sql('close', 20)}) select symbol, ts, round(ema10, 6) as ema10, round(ema20, 6) as ema20 from e10 join e20 using (symbol, ts)",
)
def _(spark, sf):
    spans = {"ema10": ("close", 10), "ema20": ("close", 20)}
    reach = max(1 << win.ema_span(n).bit_length() for _, n in spans.values())
    return rounded(bl.in_blocks(ticks(spark, sf), reach, lambda df, w: bl.with_ema(df, spans, w), rows=4 * ROWS), ["symbol", "ts"], list(spans))


_WINDOW = """, p as (select a.ts, b.t, product(1 + b.ret) over (partition by a.t order by b.t) as eq from r a join r b on b.t between a.t - 251 and a.t where a.t >= 252),
    q as (select *, max(eq) over (partition by ts order by t) as peak from p), d as (select ts, least(0, min(eq / peak - 1)) as deepest from q group by 1)"""


@query("win06_rolling_drawdown_in_blocks", _TICKS + _WINDOW + " select 'all' as symbol, ts, round(deepest, 8) as rolling_max_drawdown from d")
def _(spark, sf):
    out = bl.in_blocks(ticks(spark, sf), 251, lambda df, w: bl.with_rolling_drawdown(df, 252, w=w), rows=4 * ROWS)
    return rounded(out.where("rolling_max_drawdown is not null"), ["symbol", "ts"], ["rolling_max_drawdown"], 8)


@query(
    "win08_rolling_tails_in_blocks",
    _TICKS + ", q as (select *, case when t >= 252 then quantile_cont(ret, 0.05) over (order by t rows between 251 preceding and current row) end as q from r), s as (select a.ts, max(a.q) as q, avg(b.ret) as es from q a join r b on b.t between a.t - 251 and a.t where b.ret <= a.q group by 1) select 'all' as symbol, ts, round(q, 8) as rolling_var, round(es, 8) as rolling_es from s",
)
def _(spark, sf):
    out = ind.rolling_tails(ticks(spark, sf), 252, 0.05, rows=4 * ROWS)
    return rounded(out.where("rolling_var is not null"), ["symbol", "ts"], ["rolling_var", "rolling_es"], 8)


@query("sim01_vector_backtest_in_blocks", sql.bars("h", VECTOR) + "select symbol, ts, signal, round(sret, 8) + 0.0 as strategy_ret, round(equity, 8) + 0.0 as equity, round(buy_hold, 8) + 0.0 as buy_hold from vd")
def _(spark, sf):
    run = bt.vector_backtest_in_blocks(sig.momentum(hourly(spark, sf)), fee=0.001, rows=128)
    return rounded(run, ["symbol", "ts", "signal"], ["strategy_ret", "equity", "buy_hold"], 8)


_SHARES = (0.01, 0.05, 0.5, 0.75, 0.99)


@query(
    "agg09_viz01_exact_quantiles",
    "with v as (select l_returnflag as symbol, l_extendedprice / l_quantity as price from lineitem) " + " union all ".join(f"select symbol, {q}::double as fraction, count(*) as n, round(quantile_cont(price, {q}), 6) as quantile from v group by 1" for q in _SHARES),
)
def _(spark, sf):
    price = src.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("symbol"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    return rd(qs.exact_quantiles(price, _SHARES, "price", limit=1000), ["symbol", "fraction", "n"])


_LEVELS = (0.9, 0.95, 0.99)


@query(
    "agg09_12_38_historical_tails",
    _TICKS + ", q as (" + " union all ".join(f"select {x}::double as level, quantile_cont(ret, {1 - x!r}) as var from r" for x in _LEVELS) + ") select 'all' as symbol, level, round(max(var), 8) as var, round(avg(ret), 8) as cvar from q join r on ret <= var group by level",
)
def _(spark, sf):
    out = qs.historical_tails(ticks(spark, sf), _LEVELS, limit=200)
    return rounded(out, ["symbol", "level"], ["var", "cvar"], 8)


def phi_sql(z: str) -> str:
    """The normal distribution function by its series in odd powers over double factorials."""
    terms = "sign({z}) * exp((2 * k + 1) * ln(greatest(abs({z}), 1e-300)) - ((k + 1) * ln(2) + lgamma(k + 1.5) - 0.5 * ln(pi())))".replace("{z}", z)
    return f"(case when {z} > 7.5 then 1 when {z} < -7.5 then 0 else 0.5 + exp(-{z} * {z} / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 150), lambda k: {terms})) end)"


_KOLMOGOROV = "(case when st <= 0 or st * (sqrt(n) + 0.12 + 0.11 / sqrt(n)) < 0.2 then 1 else least(1, greatest(0, 2 * list_sum(list_transform(range(1, 101), lambda k: (case when k % 2 = 1 then 1 else -1 end) * exp(-2 * pow(k * st * (sqrt(n) + 0.12 + 0.11 / sqrt(n)), 2)))))) end)"
_RANKED = f""", mm as (select series, count(*) as n, avg(ret) as mu, stddev_samp(ret) as sd, min(ret) as lo, max(ret) as hi from s group by 1), k0 as (select s.series, ret, n, row_number() over (partition by s.series order by ret) as i, (ret - mu) / sd as z, (ret - lo) / (hi - lo) as v from s join mm using (series)),
    k as (select *, {phi_sql('z')} as u, {phi_sql('(-z)')} as w from k0), ks as (select series, max(n) as n, max(greatest(i / n - u, u - (i - 1) / n)) as dn, max(greatest(i / n - v, v - (i - 1) / n)) as du, -max(n) - sum((2 * i - 1) * ln(u) + (2 * n + 1 - 2 * i) * ln(w)) / max(n) as ad from k group by 1),
    g as (select series, ret, rank() over (partition by series order by abs(ret)) + (count(*) over (partition by series, abs(ret)) - 1) / 2 as rk, count(*) over (partition by series, abs(ret)) as c from s where ret <> 0),
    wx as (select series, count(*)::double as m, sum(rk) filter (where ret > 0) as plus, sum(rk) filter (where ret < 0) as minus, sum(c * c - 1) as even from g group by 1), wz as (select *, least(plus, minus) as st, (least(plus, minus) - m * (m + 1) / 4) / sqrt(m * (m + 1) * (2 * m + 1) / 24 - even / 48) as z from wx),
    bo as (select series, ret from s union all select distinct series, 0.0 from s), tz as (select series, sum(c * c * c - c) as ties from (select series, ret, count(*) as c from bo group by 1, 2) group by 1),
    ux as (select series, count(*)::double as n, count(*) filter (where ret > 0) + 0.5 * count(*) filter (where ret = 0) as u from s group by 1), uz as (select series, u, (abs(u - n / 2) - 0.5) / sqrt(n / 12 * (n + 2 - ties / ((n + 1) * n))) as z from ux join tz using (series)),
    tests as (select series, 'ks_normal' as test, st as statistic, {_KOLMOGOROV} as p_value from (select series, dn as st, n from ks) union all select series, 'ks_uniform', st, {_KOLMOGOROV} from (select series, du as st, n from ks) union all select series, 'anderson_darling', ad, 0.787 / (1 + 4.0 / n - 25.0 / (n * n)) from ks
        union all select series, 'wilcoxon', st, least(1, 2 * {phi_sql('z')}) from wz union all select series, 'mann_whitney_zero', u, least(1, 2 * {phi_sql('(-greatest(z, 0))')}) from uz) """


@query("tst04_05_07_10_rank_tests", sql.bars("y", SERIES + _RANKED) + "select series, test, round(statistic, 6) as statistic, round(p_value, 6) as p_value from tests")
def _(spark, sf):
    return rd(rk.rank_tests(series(spark, sf)), ["series", "test"])


_TWO = f""", u as (select series, part, ret, rank() over (partition by series order by ret) + (count(*) over (partition by series, ret) - 1) / 2 as rk, count(*) over (partition by series, ret) as c from h),
    a as (select series, sum(rk) filter (where part = 'in') as sr, count(*) filter (where part = 'in')::double as n, count(*) filter (where part = 'out')::double as m, sum(c * c - 1) as ties from u group by 1),
    z1 as (select *, sr - n * (n + 1) / 2 as statistic, n * m / 12 * (n + m + 1 - ties / ((n + m) * (n + m - 1))) as var from a), z2 as (select *, (abs(statistic - n * m / 2) - 0.5) / sqrt(var) as z from z1)"""


def _parts(spark, sf):
    s = series(spark, sf)
    n = s.groupBy("series").agg(F.count("*").alias("n"))
    return s.join(n, "series").withColumn("part", F.when(F.col("t") < F.col("n") * 0.7, "in").otherwise("out"))


@query("tst14_mann_whitney_by_ranks", sql.bars("y", SERIES + ", " + _HALVES + _TWO) + f"select series, round(statistic, 6) as statistic, round(least(1, 2 * {phi_sql('(-greatest(z, 0))')}), 6) as p_value from z2")
def _(spark, sf):
    return rd(rk.mann_whitney_two_sample(_parts(spark, sf), "part", "in", "out"), ["series"])


@query("tst14_ks_by_ranks", sql.bars("y", SERIES + ", " + _HALVES + ", c as (select series, ret, count(*) filter (where part = 'in') as a, count(*) filter (where part = 'out') as b from h group by 1, 2), d as (select series, abs(sum(a) over w / sum(a) over (partition by series) - sum(b) over w / sum(b) over (partition by series)) as d from c window w as (partition by series order by ret))") + "select series, round(max(d), 6) as statistic from d group by 1")
def _(spark, sf):
    return rd(rk.ks_two_sample(_parts(spark, sf), "part", "in", "out"), ["series"])
