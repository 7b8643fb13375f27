"""Trading rules: bars in, bars with a column `signal` out: 1 buy, -1 sell, 0 hold.

A rule sees its symbol's bars up to the current one only, because every frame ends there. Rules that depend on their own
position are written without a loop: what decides the position is the last bar that sets it, or that and
the parity of the bars since then that turn it round.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import windows as win
from . import indicators as ind

def _signal(df: DataFrame, buy: Column, sell: Column | None = None, *temporary: str) -> DataFrame:
    s = F.when(buy, 1)
    if sell is not None:
        s = s.when(sell, -1)
    return df.withColumn("signal", s.otherwise(0).cast("int")).drop(*temporary)


def _t(bars: DataFrame) -> DataFrame:
    return bars if "t" in bars.columns else ind.with_returns(bars)


def momentum(bars: DataFrame, lookback: int = 20, threshold: float = 0.02) -> DataFrame:
    df = _t(bars).withColumn("_m", win.simple_return("close", lookback))
    return _signal(df, F.col("_m") > threshold, F.col("_m") < -threshold, "_m")


def volume_momentum(bars: DataFrame, lookback: int = 20, threshold: float = 0.02, volume_window: int = 10, ratio: float = 1.2) -> DataFrame:
    recent = win.full(F.col("volume"), volume_window, F.avg, -volume_window, -1)
    older = win.full(F.col("volume"), volume_window, F.avg, -2 * volume_window, -volume_window - 1)
    df = _t(bars).withColumns({"_m": win.simple_return("close", lookback), "_v": F.coalesce(recent / F.nullif(older, F.lit(0.0)), F.lit(1.0))})
    loud = F.col("_v") > ratio
    return _signal(df, (F.col("_m") > threshold) & loud, (F.col("_m") < -threshold) & loud, "_m", "_v")


def risk_adjusted_momentum(bars: DataFrame, lookback: int = 20, threshold: float = 0.02, vol_window: int = 29, target: float = 0.15, most: float = 3.0, periods: float = 252) -> DataFrame:
    """momentum with `size_factor`: the target over the realised volatility of the returns before, at most `most`."""
    df = momentum(bars, lookback, threshold)
    vol = win.full(F.col("ret"), vol_window, F.stddev_samp, -vol_window, -1) * math.sqrt(periods)
    return df.withColumn("_v", vol).withColumn("size_factor", F.least(F.coalesce(F.lit(target) / F.nullif("_v", F.lit(0.0)), F.lit(1.0)), F.lit(most))).drop("_v")


def dual_momentum(bars: DataFrame, absolute: int = 12, relative: int = 6, benchmark: bool = True) -> DataFrame:
    """Buys while the absolute momentum is positive and, with a benchmark (the mean return of all symbols), above its mean return."""
    df = _t(bars)
    if benchmark:
        df = df.join(df.groupBy("ts").agg(F.avg("ret").alias("_bench")), "ts")
        df = df.withColumns({"_a": win.sma("ret", relative), "_b": win.sma("_bench", relative)})
        better = F.col("_a") > F.col("_b")
    else:
        better = F.lit(True)
    df = df.withColumn("_m", win.simple_return("close", absolute))
    return _signal(df, (F.col("_m") > 0) & better, None, "_m", *(("_bench", "_a", "_b") if benchmark else ()))


def cross_sectional_momentum(bars: DataFrame, lookback: int = 20, every: int = 5, n_long: int = 1, n_short: int = 1) -> DataFrame:
    """At every `every`-th bar, ranks the symbols of one time: buys the strongest and sells the weakest."""
    df = _t(bars).withColumn("_m", win.simple_return("close", lookback)).withColumn("_on", F.col("_m").isNotNull() & ((F.col("t") - lookback) % every == 0))
    at = Window.partitionBy("ts", "_on")
    df = df.withColumns({"_top": F.row_number().over(at.orderBy(F.desc("_m"), "symbol")), "_low": F.row_number().over(at.orderBy("_m", F.desc("symbol"))), "_n": F.count("*").over(at)})
    usable = F.col("_on") & (F.col("_n") >= n_long + n_short)
    return _signal(df, usable & (F.col("_top") <= n_long), usable & (F.col("_low") <= n_short), "_m", "_on", "_top", "_low", "_n")


def bollinger_rsi(bars: DataFrame, n: int = 20, k: float = 2.0, rsi_window: int = 14, low: float = 30, high: float = 70) -> DataFrame:
    df = ind.bollinger(ind.rsi(_t(bars), rsi_window), n, k)
    warm = F.col("t") >= max(n, rsi_window)
    return _signal(df, warm & (F.col("close") <= F.col("bb_lower")) & (F.col("rsi") <= low), warm & (F.col("close") >= F.col("bb_upper")) & (F.col("rsi") >= high), "bb_mid", "bb_upper", "bb_lower", "rsi")


def reversing(df: DataFrame, enter: Column, exit_long: Column, exit_short: Column) -> DataFrame:
    """position and signal of a rule whose exits reverse: an exit from long sells, and so goes short, and the other way round.

    Flat until the first bar with enter <> 0. From then on a bar where only one exit holds sets the position whatever it
    was; a bar where both hold turns it round. So it is the last set value, turned by the parity of the turns since.
    """
    up_to_now = win.upto()
    df = df.withColumn("_enter", F.coalesce(enter, F.lit(0))).withColumn("_started", F.max((F.col("_enter") != 0).cast("int")).over(up_to_now))
    df = df.withColumn("_first", (F.col("_started") == 1) & (F.coalesce(F.lag("_started").over(win.spec()), F.lit(0)) == 0))
    a, b = F.coalesce(exit_long, F.lit(False)), F.coalesce(exit_short, F.lit(False))
    sets = F.when(F.col("_first"), F.col("_enter")).when((F.col("_started") == 1) & a & ~b, -1).when((F.col("_started") == 1) & b & ~a, 1)
    df = df.withColumns({"_set": sets, "_turn": ((F.col("_started") == 1) & ~F.col("_first") & a & b).cast("int")})
    df = df.withColumn("_turns", F.sum("_turn").over(up_to_now))
    df = df.withColumn("_base", F.last(F.when(F.col("_set").isNotNull(), F.struct("_set", "_turns")), ignorenulls=True).over(up_to_now))
    parity = F.when((F.col("_turns") - F.col("_base._turns")) % 2 == 0, 1).otherwise(-1)
    df = df.withColumn("position", F.coalesce(F.col("_base._set") * parity, F.lit(0)).cast("int"))
    changed = F.col("position") != F.coalesce(F.lag("position").over(win.spec()), F.lit(0))
    df = df.withColumn("signal", F.when(changed, F.col("position")).otherwise(0).cast("int"))
    return df.drop("_enter", "_started", "_first", "_set", "_turn", "_turns", "_base")


def latched(df: DataFrame, enter: Column, leave: Column) -> DataFrame:
    """position and signal of a rule that enters only when flat and leaves to flat, where no bar does both: the last such bar
    decides whether a position is open, and the first enter after it which one. A leave is is_exit, not a signal.
    """
    enter = F.coalesce(enter, F.lit(0))
    event = F.when(enter != 0, 1).when(F.coalesce(leave, F.lit(False)), 0)
    df = df.withColumns({"_enter": enter, "_event": event})
    df = df.withColumn("_in", F.coalesce(F.last("_event", ignorenulls=True).over(win.upto()), F.lit(0)))
    df = df.withColumn("_was", F.coalesce(F.lag("_in").over(win.spec()), F.lit(0)))
    df = df.withColumn("signal", F.when((F.col("_in") == 1) & (F.col("_was") == 0), F.col("_enter")).otherwise(0).cast("int"))
    df = df.withColumn("is_exit", (F.col("_in") == 0) & (F.col("_was") == 1))
    side = F.last(F.when(F.col("signal") != 0, F.col("signal")), ignorenulls=True).over(win.upto())
    return df.withColumn("position", F.when(F.col("_in") == 1, side).otherwise(0).cast("int")).drop("_enter", "_event", "_in", "_was")


def statistical_arbitrage(bars: DataFrame, n: int = 60, entry: float = 2.0, leave: float = 0.5, stop: float = 3.0) -> DataFrame:
    df = _t(bars).withColumn("_z", win.zscore_prior("close", n))
    z = F.col("_z")
    return reversing(df, F.when(z <= -entry, 1).when(z >= entry, -1), (z >= -leave) | (z <= -stop), (z <= leave) | (z >= stop)).drop("_z")


def pairs(bars: DataFrame, formation: int = 60, refresh: int = 20, entry: float = 2.0, leave: float = 0.5) -> DataFrame:
    """Close against its own mean of 20 bars; its spread's mean and deviation are taken anew every `refresh` bars."""
    spread = F.when(F.col("t") >= 20, F.log(F.col("close") / F.avg("close").over(win.rows(-19)))).otherwise(0.0)
    df = _t(bars).withColumn("_s", spread)
    due = (F.col("t") >= formation) & ((F.col("t") - formation) % refresh == 0)
    before = win.rows(-formation, -1)
    df = df.withColumns({"_mu": F.when(due, F.avg("_s").over(before)), "_sd": F.when(due, F.stddev_pop("_s").over(before))})
    df = df.withColumns({"_mu": win.forward_fill("_mu"), "_sd": win.forward_fill("_sd")})
    df = df.withColumn("_z", (F.col("_s") - F.col("_mu")) / F.nullif("_sd", F.lit(0.0)))
    z = F.col("_z")
    near = F.abs(z) <= leave
    return reversing(df, F.when(z <= -entry, 1).when(z >= entry, -1), near, near).drop("_s", "_mu", "_sd", "_z")


def ornstein_uhlenbeck(bars: DataFrame, n: int = 100, refresh: int = 20, z: float = 1.959963984540054) -> DataFrame:
    """Bands around the mean of a process fitted to the log prices of the last n bars, anew every `refresh` bars."""
    df = _t(bars).withColumns({"_y": F.log(F.col("close") / win.lag("close")), "_x": F.log(win.lag("close"))})
    due = (F.col("t") >= n) & ((F.col("t") - n) % refresh == 0)
    f = win.rows(-(n - 1), -1)
    slope, cut = F.regr_slope("_y", "_x").over(f), F.regr_intercept("_y", "_x").over(f)
    residual = F.sqrt(F.var_pop("_y").over(f) * (F.lit(1.0) - F.pow(F.corr("_y", "_x").over(f), F.lit(2.0))))
    df = df.withColumns({"_b": F.when(due, slope), "_a": F.when(due, cut), "_s": F.when(due, residual)})
    df = df.withColumns({c: win.forward_fill(c) for c in ("_b", "_a", "_s")})
    theta = F.when(F.col("_b") < 0, -F.col("_b")).otherwise(0.1)
    mu = -F.col("_a") / F.nullif("_b", F.lit(0.0))
    width = F.col("_s") / F.sqrt(theta * 2) * z
    df = df.withColumns({"_lo": F.exp(mu - width), "_hi": F.exp(mu + width)})
    return _signal(df, F.col("close") < F.col("_lo"), F.col("close") > F.col("_hi"), "_y", "_x", "_b", "_a", "_s", "_lo", "_hi")


def mean_reversion(bars: DataFrame, n: int = 21, width: float = 0.02) -> DataFrame:
    df = _t(bars).withColumn("_m", win.sma("close", n))
    return _signal(df, F.col("close") < F.col("_m") * (1 - width), F.col("close") > F.col("_m") * (1 + width), "_m")


def crossover(bars: DataFrame, short: int = 10, long: int = 30) -> DataFrame:
    df = _t(bars).withColumn("_d", win.sma("close", short) - win.sma("close", long))
    df = df.withColumn("_p", F.lag("_d").over(win.spec()))
    return _signal(df, (F.col("_d") > 0) & (F.col("_p") <= 0), (F.col("_d") < 0) & (F.col("_p") >= 0), "_d", "_p")


def triple_average(bars: DataFrame, a: int = 5, b: int = 20, c: int = 50) -> DataFrame:
    df = _t(bars).withColumns({"_a": win.sma("close", a), "_b": win.sma("close", b), "_c": win.sma("close", c)})
    x, y, z = F.col("_a"), F.col("_b"), F.col("_c")
    return _signal(df, (x > y) & (y > z), (x < y) & (y < z), "_a", "_b", "_c")


def breakout(bars: DataFrame, n: int = 20, width: float = 0.02, volume: float = 1.5) -> DataFrame:
    hi, lo = win.channel(n)
    df = _t(bars).withColumns({"_hi": hi, "_lo": lo, "_v": win.prior_avg("volume", n)})
    loud = F.col("volume") >= F.col("_v") * volume
    return _signal(df, (F.col("high") > F.col("_hi") * (1 + width)) & loud, (F.col("low") < F.col("_lo") * (1 - width)) & loud, "_hi", "_lo", "_v")


def donchian(bars: DataFrame, entry: int = 20, leave: int = 10) -> DataFrame:
    """Breaks of the long channel enter, breaks of the short one against the position reverse it."""
    (hi, lo), (out_hi, out_lo) = win.channel(entry), win.channel(leave)
    df = _t(bars).withColumns({"_hi": hi, "_lo": lo, "_oh": out_hi, "_ol": out_lo})
    warm = F.col("t") >= max(entry, leave)
    enter = F.when(warm & (F.col("close") > F.col("_hi")), 1).when(warm & (F.col("close") < F.col("_lo")), -1)
    return reversing(df, enter, warm & (F.col("close") < F.col("_ol")), warm & (F.col("close") > F.col("_oh"))).drop("_hi", "_lo", "_oh", "_ol")


def trend_filter(bars: DataFrame, short: int = 10, long: int = 50, adx: float = 25, high: float = 70, low: float = 30) -> DataFrame:
    df = ind.adx(ind.rsi(_t(bars))).withColumns({"_a": win.sma("close", short), "_b": win.sma("close", long)})
    strong = F.col("adx") > adx
    return _signal(df, (F.col("_a") > F.col("_b")) & strong & (F.col("rsi") < high), (F.col("_a") < F.col("_b")) & strong & (F.col("rsi") > low), "_a", "_b", "adx", "rsi")


def simple_pairs(bars: DataFrame, n: int = 31, entry: float = 2.0, leave: float = 0.5) -> DataFrame:
    df = _t(bars).withColumn("_z", win.zscore("close", n))
    z = F.col("_z")
    return latched(df, F.when(z > entry, -1).when(z < -entry, 1), F.abs(z) < leave).drop("_z")


def trend_following(bars: DataFrame, short: int = 10, long: int = 31) -> DataFrame:
    df = _t(bars).withColumns({"_a": win.sma("close", short), "_b": win.sma("close", long)})
    return _signal(df, F.col("_a") > F.col("_b"), F.col("_a") < F.col("_b"), "_a", "_b")


def volatility_breakout(bars: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    df = _t(bars).withColumn("_s", win.std("ret", n))
    return _signal(df, F.col("ret") > F.col("_s") * k, F.col("ret") < F.col("_s") * -k, "_s")


def transfer_entropy(pair: DataFrame, x: str, y: str, n: int = 30, bins: int = 10) -> DataFrame:
    """(symbol, t, te_xy, te_yx): plug-in transfer entropies, in nats, of the n values that end at each t.

    Values are put into equal-width bins of their window. Every window's counts come from one exploded table; the entropy is the mean, over
    a window's steps, of the log of the ratio of its counts. Rows are n times those of the input.
    """
    base = pair.select("symbol", F.col("t").alias("s"), F.col(x).alias("x"), F.col(y).alias("y")).where("x is not null and y is not null")
    steps = base.withColumn("t", F.explode(F.sequence(F.col("s"), F.col("s") + n - 1)))
    w = Window.partitionBy("symbol", "t")
    steps = steps.withColumn("_n", F.count("*").over(w)).where(F.col("_n") == n)

    def binned(c: str) -> Column:
        lo, hi = F.min(c).over(w), F.max(c).over(w)
        return F.coalesce(F.least(F.floor((F.col(c) - lo) / F.nullif(hi - lo, F.lit(0.0)) * bins), F.lit(bins - 1)), F.lit(0))

    steps = steps.withColumns({"bx": binned("x"), "by": binned("y")})
    o = w.orderBy("s")
    steps = steps.withColumns({"px": F.lag("bx").over(o), "py": F.lag("by").over(o)}).where("px is not null")
    count = lambda *c: F.count("*").over(Window.partitionBy("symbol", "t", *c))
    steps = steps.withColumns(
        {"n_yyx": count("by", "py", "px"), "n_y": count("py"), "n_yx": count("py", "px"), "n_yy": count("by", "py"), "n_xxy": count("bx", "px", "py"), "n_x": count("px"), "n_xx": count("bx", "px")}
    )
    c = F.col
    return steps.groupBy("symbol", "t").agg(
        F.avg(F.log(c("n_yyx") * c("n_y") / (c("n_yx") * c("n_yy")))).alias("te_xy"), F.avg(F.log(c("n_xxy") * c("n_x") / (c("n_yx") * c("n_xx")))).alias("te_yx")
    )


def composite_pair(pair: DataFrame, window: int = 60, te_window: int = 30, entry: float = 2.0, leave: float = 0.5, gate: float = 0.01) -> DataFrame:
    """The spread's z-score, entered only where information flows between the legs, and in the direction it flows."""
    p = ind.hedge_ratio(pair, "a", "b", window)
    p = p.withColumns({"t": F.row_number().over(win.spec()) - 1, "ra": win.simple_return("a"), "rb": win.simple_return("b")})
    te = transfer_entropy(p, "ra", "rb", te_window).select("symbol", (F.col("t") + 1).alias("t"), "te_xy", "te_yx")  # the windows end at the bar before
    p = p.join(te, ["symbol", "t"], "left").withColumn("z", F.when(F.col("t") >= 2 * window - 1, win.zscore("spread", window, F.stddev_pop)))
    open_ = F.greatest("te_xy", "te_yx") >= gate
    ratio = F.col("te_xy") / (F.col("te_yx") + 1e-8)
    enter = F.when(open_ & (F.col("z") > entry) & (ratio < 1), -1).when(open_ & (F.col("z") < -entry) & (ratio > 1), 1)
    return latched(p.withColumn("ratio", ratio), enter, open_ & (F.abs("z") < leave))


#: Rules by name, for batch runs.
RULES: dict[str, Callable[..., DataFrame]] = {
    f.__name__: f
    for f in (
        momentum, volume_momentum, risk_adjusted_momentum, dual_momentum, cross_sectional_momentum, bollinger_rsi, statistical_arbitrage, pairs, ornstein_uhlenbeck, mean_reversion, crossover,
        triple_average, breakout, donchian, trend_filter, simple_pairs, trend_following, volatility_breakout,
    )
}

#: Lowest and highest sensible value of each rule's parameters. Fixed values; the names are those of the rules here.
BOUNDS: dict[str, dict[str, tuple[float, float]]] = {
    "momentum": {"lookback": (5, 50), "threshold": (0.005, 0.1)},
    "volume_momentum": {"lookback": (10, 50), "volume_window": (5, 20), "threshold": (0.01, 0.08), "ratio": (1.1, 2.0)},
    "risk_adjusted_momentum": {"lookback": (10, 50), "vol_window": (15, 60), "threshold": (0.01, 0.08), "target": (0.05, 0.3)},
    "dual_momentum": {"absolute": (6, 24), "relative": (3, 12)},
    "cross_sectional_momentum": {"lookback": (10, 60), "n_long": (1, 5), "n_short": (1, 5), "every": (1, 20)},
    "bollinger_rsi": {"n": (10, 50), "k": (1.5, 3.0), "rsi_window": (10, 20), "low": (20, 35), "high": (65, 80)},
    "statistical_arbitrage": {"n": (30, 120), "entry": (1.5, 3.0), "leave": (0.2, 1.0), "stop": (2.5, 4.0)},
    "pairs": {"formation": (40, 100), "refresh": (10, 40), "entry": (1.5, 3.0), "leave": (0.2, 1.0)},
    "ornstein_uhlenbeck": {"n": (50, 200), "refresh": (10, 50)},
    "mean_reversion": {"n": (10, 60), "width": (0.005, 0.05)},
    "crossover": {"short": (5, 20), "long": (20, 50)},
    "triple_average": {"a": (3, 10), "b": (15, 30), "c": (40, 80)},
    "breakout": {"n": (10, 40), "width": (0.01, 0.05), "volume": (1.2, 2.5)},
    "donchian": {"entry": (15, 40), "leave": (5, 20)},
    "trend_filter": {"short": (5, 20), "long": (30, 80), "adx": (20, 35), "high": (65, 80), "low": (20, 35)},
    "simple_pairs": {"n": (10, 60), "entry": (1.0, 3.0), "leave": (0.1, 1.0)},
    "trend_following": {"short": (5, 20), "long": (20, 50)},
    "volatility_breakout": {"n": (10, 40), "k": (1.5, 3.0)},
}


def look_ahead_violations(bars: DataFrame, rule: Callable[[DataFrame], DataFrame], at: list[int]) -> DataFrame:
    """(symbol, t, full, truncated) wherever a rule's signal at bar t changes when the later bars are taken away."""
    base = ind.with_returns(bars)
    whole = rule(bars).select("symbol", "ts", F.col("signal").alias("full"))
    out = None
    for k in at:
        cut = base.where(F.col("t") <= k)
        last = cut.where(F.col("t") == k).select("symbol", "ts", "t")
        part = rule(cut.select(*bars.columns)).select("symbol", "ts", F.col("signal").alias("truncated"))
        found = last.join(part, ["symbol", "ts"]).join(whole, ["symbol", "ts"]).where("full <> truncated").select("symbol", "t", "full", "truncated")
        out = found if out is None else out.unionByName(found)
    return out
