"""Indicators: bars in, bars with more columns out. Each is null until its window is full unless its rule says otherwise."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import WindowSpec

from ..functions import windows as win
from ..functions.wavelet import rolling_tail
from .blocks import BLOCK_ROWS, in_blocks, with_ema, with_rolling_drawdown


def with_returns(bars: DataFrame) -> DataFrame:
    """t (ordinal from 0), ret and log_ret."""
    return bars.withColumns({"t": F.row_number().over(win.spec()) - 1, "ret": win.simple_return(), "log_ret": win.log_return()})


def enrich(bars: DataFrame, lookback: int = 0) -> DataFrame:
    """The usual columns at once, over shared windows; the first `lookback` rows of each symbol are then dropped."""
    out = with_ema(with_returns(bars), {f"ema{n}": ("close", n) for n in (10, 20)}).withColumns(
        {f"sma{n}": win.sma("close", n) for n in (10, 20, 50)}
        | {"vol20": win.std("ret", 20), "volume_sma20": win.sma("volume", 20), "hl_ratio": (F.col("high") - F.col("low")) / F.col("close")}
    )
    return out.withColumn("volume_ratio", F.col("volume") / F.nullif("volume_sma20", F.lit(0.0))).where(F.col("t") >= lookback)


def rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    """rsi by simple means: 50 before there are n differences, 100 without losses."""
    d = bars.withColumn("_d", win.difference())
    gain = win.full(F.greatest("_d", F.lit(0.0)), n, F.avg, 1 - n)
    loss = win.full(F.greatest(-F.col("_d"), F.lit(0.0)), n, F.avg, 1 - n)
    # greatest() skips nulls, so the first row, which has no difference, must not count as a value
    known = F.count("_d").over(win.rows(1 - n)) == n
    d = d.withColumns({"_gain": gain, "_loss": loss, "_known": known})
    value = F.when(~F.col("_known"), 50.0).when(F.col("_loss") == 0, 100.0).otherwise(F.lit(100.0) - F.lit(100.0) / (F.col("_gain") / F.nullif("_loss", F.lit(0.0)) + 1))
    return d.withColumn("rsi", value).drop("_d", "_gain", "_loss", "_known")


def atr(bars: DataFrame, n: int = 14) -> DataFrame:
    """atr: the mean of n true ranges; high - low while there are fewer."""
    d = bars.withColumns({"_before": win.lag("close")})
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("_before")), F.abs(F.col("low") - F.col("_before")))
    d = d.withColumn("_tr", F.when(F.col("_before").isNotNull(), tr))
    return d.withColumn("atr", F.coalesce(win.full(F.col("_tr"), n, F.avg, 1 - n), F.col("high") - F.col("low"))).drop("_before", "_tr")


def adx(bars: DataFrame, n: int = 14) -> DataFrame:
    """adx as the directional index of one window; 25 while there are fewer than n moves or nothing moves."""
    d = bars.withColumns({"_up": win.difference("high"), "_down": -win.difference("low"), "_before": win.lag("close")})
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("_before")), F.abs(F.col("low") - F.col("_before")))
    d = d.withColumns(
        {
            "_tr": F.when(F.col("_before").isNotNull(), tr),
            "_plus": F.when(F.col("_up").isNotNull(), F.when((F.col("_up") > F.col("_down")) & (F.col("_up") > 0), F.col("_up")).otherwise(0.0)),
            "_minus": F.when(F.col("_up").isNotNull(), F.when((F.col("_down") > F.col("_up")) & (F.col("_down") > 0), F.col("_down")).otherwise(0.0)),
        }
    )
    mean = lambda c: win.full(F.col(c), n, F.avg, 1 - n)
    d = d.withColumns({"_a": mean("_tr"), "_p": mean("_plus"), "_m": mean("_minus")})
    plus, minus = F.col("_p") / F.nullif("_a", F.lit(0.0)), F.col("_m") / F.nullif("_a", F.lit(0.0))
    value = F.abs(plus - minus) / F.nullif(plus + minus, F.lit(0.0)) * 100
    return d.withColumn("adx", F.coalesce(value, F.lit(25.0))).drop("_up", "_down", "_before", "_tr", "_plus", "_minus", "_a", "_p", "_m")


def bollinger(bars: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    mid, sd = win.sma("close", n), win.std("close", n)
    return bars.withColumns({"bb_mid": mid, "bb_upper": mid + sd * k, "bb_lower": mid - sd * k})


def rolling_metrics(returns: DataFrame, n: int = 63, periods: float = 252) -> DataFrame:
    """Rolling Sharpe, volatility and maximum drawdown of the column ret."""
    out = with_rolling_drawdown(returns, n)
    return out.withColumns({"rolling_sharpe": win.rolling_sharpe("ret", n, periods), "rolling_volatility": win.std("ret", n) * math.sqrt(periods)})


def rolling_tails(returns: DataFrame, n: int = 63, level: float = 0.05, keys: Sequence[str] = win.KEYS, order: str = win.ORDER, rows: int = BLOCK_ROWS) -> DataFrame:
    """Rolling VaR and expected shortfall of ret: order statistics of all frames of a block at once, at a cost of the logarithm of a block for each.

    A task holds one block, some 300 bytes a row. NaN counts as null; frames with either are null.
    """

    def tails(block: pa.Table) -> pa.Table:
        block = block.sort_by(order)
        found = rolling_tail(block["ret"].to_numpy(), n, level)
        for name, values in zip(("rolling_var", "rolling_es"), found):
            block = block.append_column(name, pa.array(values, pa.float64(), from_pandas=True))
        return block

    def add(dealt: DataFrame, _: WindowSpec) -> DataFrame:
        schema = StructType([*dealt.schema.fields, StructField("rolling_var", DoubleType()), StructField("rolling_es", DoubleType())])
        return dealt.groupBy(*keys, "_piece").applyInArrow(tails, schema)

    return in_blocks(returns, n - 1, add, keys, order, rows)


def rolling_risk(returns: DataFrame, n: int = 63, level: float = 0.05) -> DataFrame:
    """Rolling VaR, expected shortfall, population volatility, skewness and excess kurtosis of ret."""
    r = F.col("ret")
    return rolling_tails(returns, n, level).withColumns({f"rolling_{k}": win.full(r, n, f, 1 - n) for k, f in (("volatility", F.stddev_pop), ("skewness", F.skewness), ("kurtosis", F.kurtosis))})


def hedge_ratio(pair: DataFrame, a: str, b: str, n: int = 60) -> DataFrame:
    """hedge: the slope of log a on log b over the last n rows, 1 until there are n; and the spread log a - hedge * log b."""
    x, y = F.log(F.col(b)), F.log(F.col(a))
    f = win.rows(1 - n)
    hedge = F.when(F.count(y).over(f) == n, F.regr_slope(y, x).over(f))
    return pair.withColumn("hedge", F.coalesce(hedge, F.lit(1.0))).withColumn("spread", y - F.col("hedge") * x)


def drawdowns(equity: DataFrame, value: str = "equity") -> DataFrame:
    """peak, drawdown (at most 0) and island: the number of bars at a peak so far, which is constant in a drawdown."""
    out = equity.withColumn("peak", F.max(value).over(win.upto()))
    out = out.withColumn("drawdown", F.col(value) / F.nullif("peak", F.lit(0.0)) - 1)
    return out.withColumn("island", F.sum((F.col("drawdown") >= 0).cast("long")).over(win.upto()))


def drawdown_periods(equity: DataFrame, value: str = "equity") -> DataFrame:
    """One row for each drawdown: its first and last bar under water, bars, depth, peak, trough, and when the peak was regained."""
    marked = drawdowns(equity, value).withColumn("_next", F.lead("ts").over(win.spec()))
    under = marked.where("drawdown < 0")
    return under.groupBy("symbol", "island").agg(
        F.min("ts").alias("start"),
        F.max("ts").alias("end"),
        F.count("*").alias("bars"),
        F.min("drawdown").alias("magnitude"),
        F.max("peak").alias("peak_value"),
        F.min(value).alias("trough_value"),
        F.max_by("_next", "ts").alias("recovered_at"),
    ).withColumn("recovered", F.col("recovered_at").isNotNull())


def streaks(returns: DataFrame) -> DataFrame:
    """Longest runs of wins and losses of each symbol; a zero ends either."""
    sign = returns.where(F.col("ret").isNotNull()).withColumn("_sign", F.signum("ret"))
    changed = sign.withColumn("_new", (F.col("_sign") != F.coalesce(F.lag("_sign").over(win.spec()), F.lit(9.0))).cast("long"))
    runs = changed.withColumn("_run", F.sum("_new").over(win.upto())).groupBy("symbol", "_run", "_sign").agg(F.count("*").alias("n"))
    longest = lambda s: F.coalesce(F.max(F.when(F.col("_sign") == s, F.col("n"))), F.lit(0)).cast("long")
    return runs.groupBy("symbol").agg(longest(1).alias("max_wins"), longest(-1).alias("max_losses"))


def within(x: Column, lo: Column, hi: Column) -> Column:
    return F.least(F.greatest(x, lo), hi)
