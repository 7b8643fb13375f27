"""User metrics, rules folded over a stream, searches with tree surrogates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import rng
from ..operators import optimize as opt
from ..operators import resample as rs
from ..operators import surrogates as su
from ..operators import user_metrics as um
from ..sources import config
from ..sources.shared import folder, written
from ..streaming.fold import STORE, DonchianAccount, fold_stream
from . import sql
from .q_metrics import rd
from .q_portfolio import _SC, _score, grid_of, scored
from .q_resample import N, SERIES, _stats_sql, path_stats, samples, series
from .q_signals import _DC, loop, machine
from .q_windows import damped_hourly, damped_weekly, r, rounded
from .registry import query


def autocovariance(x: np.ndarray) -> float | None:
    """The mean product of neighbours: depends on the order, and is none of the built-in metrics."""
    return float((x[1:] * x[:-1]).mean()) if len(x) > 1 else None


def drawdown(x: np.ndarray) -> float:
    """A twin of the built-in maximum drawdown."""
    equity = np.cumprod(1 + x)
    return float((equity / np.maximum.accumulate(equity) - 1).min())


_ORDER = f"pm as (select s.series, sim, row_number() over (partition by s.series, sim order by {rng.draw_sql('sim', 't', 13)}, t) as k, ret from s, (select unnest(range({N})) as sim))"
_AC = "avg(ret * before)"


@query(
    "prm02_user_metric_autocovariance",
    sql.bars("y", SERIES + ", " + _ORDER + f""", pl as (select *, lag(ret) over (partition by series, sim order by k) as before from pm), pv as (select series, sim, {_AC} as v from pl group by 1, 2),
    ol as (select *, lag(ret) over (partition by series order by t) as before from s), ov as (select series, {_AC} as o from ol group by 1)""")
    + "select series, round(o, 9) as observed, count(*) as n_sims, round((count(*) filter (where v >= o - 1e-12) + 1) / (count(*) + 1), 6) as p_greater, round((count(*) filter (where v <= o + 1e-12) + 1) / (count(*) + 1), 6) as p_less from pv join ov using (series) group by series, o",
)
def _(spark, sf):
    out = um.permutation_test(series(spark, sf), um.ArrayMetric(autocovariance), N, seed=13)
    return out.select("series", r(F.col("observed"), 9).alias("observed"), "n_sims", r(F.col("p_greater")).alias("p_greater"), r(F.col("p_less")).alias("p_less"))


@query(
    "bst10_user_metric_interval",
    sql.bars("y", samples("block") + ", pv as (select series, sim, mad(ret) as v from p group by 1, 2)") + "select series, round(avg(v), 6) as mean, round(quantile_cont(v, 0.025), 6) as lo, round(quantile_cont(v, 0.975), 6) as hi from pv group by 1",
)
def _(spark, sf):
    metric = um.ArrayMetric(lambda x: float(np.median(np.abs(x - np.median(x)))))
    return rd(um.bootstrap_interval(series(spark, sf), metric, N, "block", 20, 7), ["series"])


@query(
    "win07_user_metric_rolling",
    sql.bars("y", """w as (select a.symbol, a.ts, b.t, product(1 + b.ret) over (partition by a.symbol, a.t order by b.t) as eq from r a join r b on a.symbol = b.symbol and b.t between a.t - 20 and a.t where a.t >= 21), v as (select *, max(eq) over (partition by symbol, ts order by t) as peak from w)""")
    + "select symbol, ts, round(min(eq / peak - 1), 6) as by_array, round(min(eq / peak - 1), 6) as by_lags from v group by 1, 2",
)
def _(spark, sf):
    """The user's drawdown beside the built-in one."""
    from ..operators import blocks as bl
    from ..operators import indicators as ind

    both = bl.with_rolling_drawdown(um.rolling_metric(ind.with_returns(damped_weekly(spark, sf)), um.ArrayMetric(drawdown), 21, name="by_array"), 21, name="by_lags")
    return rounded(both.where("by_array is not null"), ["symbol", "ts"], ["by_array", "by_lags"])


_FOLDED = _DC.replace("y as materialized", "d as materialized") + ", " + machine("d", "(case when close > hi then 1 when close < lo then -1 else 0 end)", "(case when close < ol then -1 else 1 end)", "(case when close > oh then 1 else -1 end)")
_FOLDED += ", y as materialized (select walk.symbol, walk.t, walk.ts, r.close, walk.signal from walk join r using (symbol, t) union all select distinct symbol, -1, null, null, 0 from r), " + loop(False)


@query(
    "ext_streaming_donchian_account",
    sql.bars("x", _FOLDED).replace("with bars", "with recursive bars", 1)
    + "select ev.symbol, ev.ts, cast(walk.position as int) as position, cast(walk.signal as int) as signal, side as direction, round(case side when 1 then cash + units * close when -1 then cash + units * (entry - close) else cash end, 4) as equity, ev.epoch from ev join walk on walk.symbol = ev.symbol and walk.t = ev.t where ev.t >= 0",
)
def _(spark, sf):
    """The bars come in three starts of the stream; two last rows far ahead move the watermark past all of them."""
    session = spark.newSession()
    session.conf.set(*STORE)
    place, path, marks = (folder(spark, f"fold-{x}") for x in ("in", "out", "marks"))
    bars = damped_hourly(session, sf).select("symbol", F.col("ts").cast("timestamp").alias("ts"), "high", "low", "close")
    lo, hi = bars.agg(F.min("ts"), F.max("ts")).first()
    cuts = [lo + (hi - lo) * k / 3 for k in (1, 2)]
    parts = [bars.where(F.col("ts") <= cuts[0]), bars.where((F.col("ts") > cuts[0]) & (F.col("ts") <= cuts[1])), bars.where(F.col("ts") > cuts[1])]
    far = lambda days: session.createDataFrame([("end", 1.0)], "symbol string, high double").select("symbol", (F.lit(hi) + F.expr(f"interval {days} days")).alias("ts"), "high", F.lit(1.0).alias("low"), F.lit(1.0).alias("close"))
    for part in [*parts, far(30), far(31)]:
        part.coalesce(1).write.mode("append").parquet(place)
        stream = session.readStream.schema(bars.schema).parquet(place)
        fold_stream(stream, DonchianAccount()).writeStream.outputMode("append").option("checkpointLocation", marks).option("path", path).format("parquet").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(path).where("symbol <> 'end'").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return out.select("symbol", "ts", "position", "signal", "direction", r(F.col("equity"), 4).alias("equity"), F.col("epoch").cast("int").alias("epoch"))


_POINTS = [(k, lookback, threshold) for k, (lookback, threshold) in enumerate((a, round(0.004 * b, 3)) for a in range(4, 40, 4) for b in range(1, 9))]
_SURFACE = f"""g as (select * from (values {', '.join(f'({k}, {a}, {b}::double)' for k, a, b in _POINTS)}) v(params_id, lookback, threshold)), mo as (select a.symbol, a.ts, a.ret, params_id, a.close / b.close - 1 as mo, threshold from r a cross join g left join r b on b.symbol = a.symbol and b.t = a.t - lookback),
    sg as (select *, case when mo > threshold then 1 when mo < -threshold then -1 else 0 end as sig from mo), sv as (select symbol, params_id, coalesce(lag(sig) over (partition by symbol, params_id order by ts), 0) * coalesce(ret, 0) as sr from sg),
    so as (select symbol, params_id, avg(sr) / nullif(stddev_samp(sr), 0) * sqrt(252) as score from sv group by 1, 2), sc as (select params_id, avg(score) as score from so group by 1)"""


@query(
    "opt03_surrogate_searches",
    sql.bars("x", _SURFACE) + "select surrogate, params_id, lookback, threshold, round(score, 6) as score from (select * from sc join g using (params_id) order by score desc, params_id limit 1), (select unnest(['gaussian', 'forest', 'boosted']) as surrogate)",
)
def _(spark, sf):
    """The best of 72 candidates, found by each surrogate with 48 of them scored."""
    bars = written(damped_hourly(spark, sf), "search-bars")

    def evaluate(chosen):
        params = spark.createDataFrame([_POINTS[k] for k in chosen], "params_id int, lookback int, threshold double")
        found = {x.params_id: x.s for x in _score(scored(bars, params)).groupBy("params_id").agg(F.avg("score").alias("s")).collect()}
        return [found.get(k) if found.get(k) is not None else float("-inf") for k in chosen]

    rows = []
    for name in su.SURROGATES:
        k, score = max(su.search(evaluate, np.array([p[1:] for p in _POINTS], float), name, rounds=6, batch=8, seed=1), key=lambda x: (x[1], -x[0]))
        rows.append((name, *_POINTS[k], round(score, 6)))
    return spark.createDataFrame(rows, "surrogate string, params_id int, lookback int, threshold double, score double")


@query("win32_ranked_candidates", sql.bars("x", _SC) + "select symbol, params_id, round(score, 6) as score, row_number() over (partition by symbol order by score desc nulls last, params_id)::int as rank from so")
def _(spark, sf):
    out = opt.ranked(_score(scored(damped_hourly(spark, sf), grid_of(spark))), ["symbol"])
    return out.select("symbol", "params_id", r(F.col("score")).alias("score"), "rank")


_PROFILES = """
short: {n_sims: 250, batch_size: 50, block_length: 5, method: IID}
"""


@query("snk09_bst01_profile_from_yaml", sql.bars("y", samples("iid", 50) + ", " + _stats_sql()) + "select series, sim, round(total_return, 6) as total_return, round(volatility, 6) as volatility, round(sharpe, 6) as sharpe, round(max_drawdown, 6) as max_drawdown from st")
def _(spark, sf):
    """A profile of a user's file, cut to its validation profile, decides how the series are resampled."""
    profile = config.validation_profile(config.load_profiles(_PROFILES)["short"])
    paths = rs.resample(series(spark, sf), profile.n_sims, profile.method, profile.block_length, 7)
    return rd(path_stats(paths), ["series", "sim"])
