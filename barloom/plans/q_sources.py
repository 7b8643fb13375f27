"""Sources and sinks: what is written is read back; synthetic series; the streaming extension run to its end."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import rng
from ..operators import indicators as ind
from ..sources import bars as src
from ..sources import reports, synthetic
from ..sources.shared import folder
from ..streaming import bars as streaming
from ..streaming.fold import BOUNDED, STORE
from . import sql
from .q_metrics import rd
from .q_windows import _OHLCV, daily, damped_hourly, hourly, r, rounded, rounded_sql
from .q_signals import _ALGEBRA
from .registry import query


@query("src01_02_snk01_partitioned_parquet", sql.bars("d") + f"select {rounded_sql(['symbol', 'ts'], {c: c for c in _OHLCV})} from bars where symbol in ('A', 'N') and ts >= timestamp '1996-02-10' and ts < timestamp '1997-03-06'")
def _(spark, sf):
    path = folder(spark, "bars")
    src.write_bars(daily(spark, sf), path, "1d")
    return rounded(src.read_bars(spark, path, ["A", "N"], "1d", "1996-02-10", "1997-03-05"), ["symbol", "ts"], _OHLCV)


@query("src02_snk02_csv_round_trip", sql.bars("w") + f"select {rounded_sql(['symbol', 'ts'], {c: c for c in _OHLCV})} from bars where symbol = 'A'")
def _(spark, sf):
    from .q_windows import weekly

    path = folder(spark, "csv")
    a = weekly(spark, sf).where("symbol = 'A'").select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Date"), *[F.col(c).alias(c.upper()) for c in _OHLCV])
    reports.write_csv(a, path)
    return rounded(src.read_csv_bars(spark, path, "A"), ["symbol", "ts"], _OHLCV)


@query("src04_set02_multi_symbol_closes", sql.bars("d") + "select ts, round(max(close) filter (where symbol = 'A'), 6) as \"A\", round(max(close) filter (where symbol = 'N'), 6) as \"N\", round(max(close) filter (where symbol = 'R'), 6) as \"R\" from bars group by ts having count(*) = 3")
def _(spark, sf):
    wide = src.aligned(daily(spark, sf), ["A", "N", "R"])
    return wide.select("ts", *[r(F.col(c)).alias(c) for c in ("A", "N", "R")])


def _gbm_sql(n: int, price: float, vol: float, drift: float, seed: int) -> str:
    dt = 1 / 252
    v = f"(case when (t * 4 // {n}) % 2 = 0 then {vol * 0.8!r}::double else {vol * 1.3!r}::double end)"
    mu = f"(case when (t * 4 // {n}) % 2 = 0 then {drift * 1.5!r}::double else {drift * 0.3!r}::double end)"
    wick = lambda k: f"abs({rng.normal_sql('t', str(k), seed)}) * {vol!r}::double * {math.sqrt(dt)!r}::double / 2"
    return f"""with g as (select t, ({mu} - {v} * {v} / 2) * {dt!r}::double + {v} * {math.sqrt(dt)!r}::double * {rng.normal_sql('t', '1', seed)} as r from (select unnest(range({n})) as t)), c as (select *, {price!r}::double * exp(sum(r) over (order by t)) as close from g),
        o as (select *, coalesce(lag(close) over (order by t), {price!r}::double) as open from c) select timestamp '2020-01-01' + to_days(t::int) as ts, round(open, 6) as open, round(greatest(open, close) * (1 + {wick(2)}), 6) as high, round(least(open, close) * (1 - least({wick(3)}, 0.9)), 6) as low, round(close, 6) as close,
        floor((abs(r) * 20 + 1) * ({rng.uniform_sql('t', '4', seed)} + 0.5) * 1000000)::double as volume from o"""


for _name, (_p, _v, _d, _s) in synthetic.PRESETS.items():

    def _preset(name):
        def run(spark, sf):
            return rounded(synthetic.preset(spark, name, 400), ["ts", "volume"], ["open", "high", "low", "close"])

        return run

    query(f"src06_07_synthetic_{_name}", _gbm_sql(400, _p, _v, _d, _s))(_preset(_name))


@query("src08_benchmark_series")
def _(spark, sf):
    return rounded(synthetic.benchmarks(spark, 300), ["symbol", "ts"], ["open", "high", "low", "close"])


@query("src09_correlated_returns", "with z as (select t, j, " + rng.normal_sql("t", "j", 5) + " as z from (select unnest(range(500)) as t), (select unnest(range(2)) as j)), w as (select t, max(z) filter (where j = 0) as z0, max(z) filter (where j = 1) as z1 from z group by 1) select t, 'Asset_1' as symbol, round(0.05::double / 252 + 0.15::double / sqrt(252) * z0, 8) as ret from w union all select t, 'Asset_2', round(0.15::double / 252 + 0.40::double / sqrt(252) * (0.3::double * z0 + sqrt(1 - 0.3::double * 0.3) * z1), 8) from w")
def _(spark, sf):
    return rounded(synthetic.multi_asset_returns(spark, 2, 500), ["t", "symbol"], ["ret"], 8)


@query("snk02_03_set03_describe", sql.bars("d") + " union all ".join(f"select symbol, '{c}' as \"column\", count({c}) as \"count\", round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std, round(min({c}), 6) as min, round(quantile_cont({c}, 0.25), 6) as p25, round(quantile_cont({c}, 0.5), 6) as p50, round(quantile_cont({c}, 0.75), 6) as p75, round(max({c}), 6) as max from r group by 1" for c in ("close", "ret", "volume")))
def _(spark, sf):
    return rd(reports.describe(ind.with_returns(daily(spark, sf)), ["close", "ret", "volume"], ["symbol"]), ["symbol", "column", "count"])


@query("snk04_05_json_of_trades", sql.bars("x", _ALGEBRA) + "select symbol, cast(dir as int) as direction, entry_ts, exit_ts, round(pnl, 4) + 0.0 as pnl from tp")
def _(spark, sf):
    from ..operators import backtest as bt
    from ..operators import signals as sig

    t = bt.trades(bt.event_backtest(sig.momentum(damped_hourly(spark, sf))))
    path = folder(spark, "json")
    reports.write_json(t.select("symbol", "direction", "entry_ts", "exit_ts", r(F.col("pnl"), 4).alias("pnl")), path)
    return spark.read.schema("symbol string, direction int, entry_ts timestamp_ntz, exit_ts timestamp_ntz, pnl double").json(path)


@query("snk06_07_sig23_reports")
def _(spark, sf):
    from ..operators import metrics as m
    from ..operators import signals as sig

    bars = hourly(spark, sf)
    perf = m.performance(ind.with_returns(bars)).orderBy("symbol")
    texts = {"markdown": reports.markdown("Performance", {"By symbol": perf}), "html": reports.html_page("Performance", {"By symbol": perf}), "bias": reports.bias_report(sig.look_ahead_violations(bars, sig.momentum, [50]))}
    return spark.createDataFrame(list(texts.items()), "kind string, body string")


@query("scalar_functions", "select event_id, round(ln(value + 1), 6) as l1, round(exp(value / 1000), 6) as e, round(sqrt(value), 6) as s, cast(floor(value) as bigint) as fl, round(least(greatest(value, 10), 100), 6) as clip, replace(replace(event_type, '/', '_'), '-', '_') as name, lower(upper(event_type)) as low, strftime(ts, '%Y-%m') as month, cast(year(ts) as int) as year, last_day(ts)::timestamp as month_end, date_diff('day', ts, timestamp '2024-02-01') as days_left from events")
def _(spark, sf):
    v, ts = F.col("value"), F.col("ts")
    return src.table(spark, sf, "events").select(
        "event_id", r(F.log1p(v)).alias("l1"), r(F.exp(v / 1000)).alias("e"), r(F.sqrt(v)).alias("s"), F.floor(v).alias("fl"), r(ind.within(v, F.lit(10.0), F.lit(100.0))).alias("clip"), F.regexp_replace("event_type", "[/-]", "_").alias("name"),
        F.lower(F.upper("event_type")).alias("low"), F.date_format(ts, "yyyy-MM").alias("month"), F.year(ts).alias("year"), F.last_day(ts).cast("timestamp_ntz").alias("month_end"), F.datediff(F.lit("2024-02-01").cast("date"), ts).cast("long").alias("days_left"),
    )


@query("ext_streaming_bars", sql.bars("h") + f"select {rounded_sql(['symbol', 'ts'], {c: c for c in _OHLCV})} from bars")
def _(spark, sf):
    path, marks = folder(spark, "stream-out"), folder(spark, "stream-marks")
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    ticks = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet*").parquet(sf).where("value > 0")
    ticks = ticks.select(F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("event_type").alias("symbol"), F.col("value").alias("price"))
    # At the end of a finished stream the open bars are still held back by the watermark; complete mode hands them over.
    run = streaming.stream_bars(ticks).writeStream.outputMode("complete").option("checkpointLocation", marks).trigger(availableNow=True)
    run.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start().awaitTermination()
    out = spark.read.parquet(path).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return rounded(out, ["symbol", "ts"], _OHLCV)


#: What a task of a stream reads or merges at most, about.
_TASK_ROWS = 500_000


def _streamed(spark, sf, made):
    """What a finished stream over the events has handed over in append mode, so that state is dropped behind the watermark. A last row far ahead moves the watermark past all others.

    All events are one batch, since later files may hold earlier times. It is dealt over more tasks the more rows there are, and its state lies on disk: no task's memory grows with the table.
    """
    place, path, marks = folder(spark, "stream-in"), folder(spark, "stream-out"), folder(spark, "stream-marks")
    events = src.table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_id", "user_id", F.col("event_type").alias("symbol"), F.col("value").alias("price"), "value")
    end = events.agg((F.max("ts") + F.expr("interval 30 days")).alias("ts")).select("ts", F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("long").alias("user_id"), F.lit("end").alias("symbol"), F.lit(0.0).alias("price"), F.lit(0.0).alias("value"))
    session = spark.newSession()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-events.count() // _TASK_ROWS))
    for name, value in (STORE, BOUNDED, ("spark.sql.shuffle.partitions", tasks), ("spark.sql.files.openCostInBytes", "1g")):  # each file is a task's
        session.conf.set(name, value)
    for part in (events, end.coalesce(1)):  # the end comes after all others
        part.write.mode("append").option("maxRecordsPerFile", _TASK_ROWS).parquet(place)
        ticks = session.readStream.schema(events.schema).parquet(place)
        made(ticks).writeStream.outputMode("append").option("checkpointLocation", marks).option("path", path).format("parquet").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path)


@query("ext_streaming_sliding_volume", "select event_type as symbol, date_trunc('hour', ts) - to_hours(k::int) as ts, count(*) as ticks, round(sum(value), 6) as total from events, (select unnest(range(6)) as k) group by 1, 2")
def _(spark, sf):
    out = _streamed(spark, sf, streaming.sliding_volume).where("symbol <> 'end'")
    return rounded(out.withColumn("ts", F.col("ts").cast("timestamp_ntz")), ["symbol", "ts", "ticks"], ["total"])


@query("ext_streaming_sessions", "with e as (select *, ts - lag(ts) over (partition by user_id order by ts) as gap from events), s as (select *, count(*) filter (where gap is null or gap > interval 30 minute) over (partition by user_id order by ts rows unbounded preceding) as k from e) select user_id, min(ts) as start, max(ts) + interval 30 minute as \"end\", count(*) as events, round(sum(value), 6) as total from s group by user_id, k")
def _(spark, sf):
    out = _streamed(spark, sf, streaming.sessions).where("user_id is not null")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "events", r(F.col("total")).alias("total"))
