"""Backtests as window algebra.

With one position at a time, what an event loop does to the account is linear in it: between two changes of the
signal (an epoch) the account is the capital at the epoch's start times a factor of price / entry price alone. So equity is
the starting capital times the product of the factors of all epochs before, times the factor so far; no loop, no state but windows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from ..functions import windows as win
from ..sources.shared import written
from .blocks import BLOCK_ROWS, Running, in_blocks, scan, time_blocks

CAPITAL, SHARE = 100_000.0, 0.95


def vector_backtest(signals: DataFrame, fee: float = 0.0) -> DataFrame:
    """strategy_ret: the signal of the bar before times the return, less a fee for each change; equity and buy_hold from 1."""
    df = signals.withColumn("_pos", F.coalesce(F.lag("signal").over(win.spec()), F.lit(0)))
    df = df.withColumn("_turn", F.abs(F.col("_pos") - F.coalesce(F.lag("_pos").over(win.spec()), F.lit(0))))
    df = df.withColumn("strategy_ret", F.coalesce(F.col("_pos") * F.col("ret"), F.lit(0.0)) - F.col("_turn") * fee)
    return df.withColumns({"equity": win.running_equity("strategy_ret"), "buy_hold": win.running_equity("ret")}).drop("_pos", "_turn")


def _factors(g: Column, k: float, a: float, compat: bool) -> tuple[Column, Column, Column, Column]:
    """Account over capital: long held, long closed, short held, short closed, at g = price / entry price."""
    spare = 1 - a * (1 + k)
    long_held = F.lit(spare) + g * a
    long_closed = F.lit(spare) + g * (2 * a * (1 - k)) - a if compat else F.lit(spare) + g * (a * (1 - k))
    short_held = F.lit(1 - k * a + a) - g * a
    short_closed = F.lit(1 - k * a + a) - g * (a + k * a)
    return long_held, long_closed, short_held, short_closed


def event_backtest(signals: DataFrame, cost: float = 0.001, slippage: float = 0.0001, share: float = SHARE, capital: float = CAPITAL, compat: bool = False) -> DataFrame:
    """signals with epoch, direction, entry_price, epoch_capital and equity of every bar.

    A signal against the position closes it and opens the other at the same close. compat books a long's profit twice when it closes.
    Where an account is used up, or a position would be under 0.01 units, not every signal opens a position and the algebra
    ends; the symbols that this happens to are walked bar by bar, each in a task of its own.
    """
    run = algebra(signals, cost, slippage, share, capital, compat)
    whole = Window.partitionBy("symbol")
    run = run.withColumn("_sound", F.min(F.col("exact").cast("int")).over(whole) == 1).drop("exact")
    run = written(run, "backtest")  # the windows are computed once, though two branches read them
    sound = run.where("_sound").drop("_sound")
    rest = run.where("not _sound").drop("_sound")
    names = ["direction", "epoch", "entry_price", "epoch_capital", "equity"]
    plain = [c for c in sound.columns if c not in names]
    schema = StructType([sound.schema[c] for c in plain] + [StructField("direction", IntegerType()), StructField("epoch", LongType())] + [StructField(c, DoubleType()) for c in names[2:]])
    walked = rest.select(*plain).groupBy("symbol").applyInPandas(_walker(cost + slippage, share, capital, compat), schema)
    return sound.select(*plain, "direction", F.col("epoch").cast("long").alias("epoch"), *names[2:]).unionByName(walked)


def _walker(k: float, share: float, capital: float, compat: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def walk(bars: pd.DataFrame) -> pd.DataFrame:
        return _walk(bars, k, share, capital, compat)

    return walk


def _walk(bars: pd.DataFrame, k: float, share: float, capital: float, compat: bool) -> pd.DataFrame:
    """The event loop over one symbol."""
    bars = bars.sort_values("ts", ignore_index=True)
    cash, units, side, entry, epoch, start = capital, 0.0, 0, 0.0, 0, capital
    rows = []
    for price, signal in zip(bars["close"], bars["signal"]):
        if signal and side and side != signal:
            if side == 1:
                gain = (price - entry) * units - units * price * k
                cash += units * price * (1 - k) + (gain if compat else 0.0)
            else:
                cash += (entry - price) * units - units * price * k
            units, side, epoch, start = 0.0, 0, epoch + 1, cash
            closed = True
        else:
            closed = False
        new = abs(cash * share / (price * (1 + k)))
        if signal and not side and new >= 0.01 and (signal == -1 or cash > 0):
            units, side, entry, start = new, int(signal), price, cash
            cash -= units * price * k + (units * price if side == 1 else 0.0)
            epoch += not closed
        held = units * price if side == 1 else units * (entry - price)
        rows.append((side, epoch, entry if side else price, start, cash + held))
    return bars.assign(**dict(zip(("direction", "epoch", "entry_price", "epoch_capital", "equity"), zip(*rows))))


def algebra(signals: DataFrame, cost: float, slippage: float, share: float, capital: float, compat: bool) -> DataFrame:
    """event_backtest by window products, with `exact`: false from where that is no longer what the loop does."""
    k = cost + slippage
    a = share / (1 + k)
    up = win.upto()
    df = signals.withColumn("direction", F.coalesce(F.last(F.when(F.col("signal") != 0, F.col("signal")), ignorenulls=True).over(up), F.lit(0)))
    df = df.withColumn("_new", (F.col("direction") != F.coalesce(F.lag("direction").over(win.spec()), F.lit(0))).cast("int"))
    df = df.withColumn("epoch", F.sum("_new").over(up))
    inside = Window.partitionBy("symbol", "epoch").orderBy("ts")
    df = df.withColumn("entry_price", F.first("close").over(inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    # On the bar that starts an epoch the one before it is closed, at the same close.
    df = df.withColumns({"_before": F.lag("entry_price").over(win.spec()), "_side": F.lag("direction").over(win.spec())})
    _, long_closed, _, short_closed = _factors(F.col("close") / F.col("_before"), k, a, compat)
    closed = F.when((F.col("_new") == 1) & (F.col("_side") == 1), long_closed).when((F.col("_new") == 1) & (F.col("_side") == -1), short_closed).otherwise(1.0)
    df = df.withColumn("_f", closed).withColumn("epoch_capital", F.product("_f").over(up) * capital)
    long_held, _, short_held, _ = _factors(F.col("close") / F.col("entry_price"), k, a, compat)
    held = F.when(F.col("direction") == 1, long_held).when(F.col("direction") == -1, short_held).otherwise(1.0)
    df = df.withColumn("equity", F.col("epoch_capital") * held)
    sound = (F.col("epoch_capital") > 0) & ((F.col("direction") == 0) | (F.col("epoch_capital") * a / F.col("entry_price") >= 0.01))
    return df.withColumn("exact", F.min(sound.cast("int")).over(up) == 1).drop("_new", "_before", "_side", "_f")


def trades(run: DataFrame, cost: float = 0.001, slippage: float = 0.0001, share: float = SHARE) -> DataFrame:
    """One row for each position: entry and exit, size (negative: short), pnl after exit costs, return, bars and days.

    The position open at the end is closed at the last close.
    """
    k = cost + slippage
    a = share / (1 + k)
    last = Window.partitionBy("symbol").orderBy("ts").rowsBetween(0, Window.unboundedFollowing)
    df = run.withColumns({"_next_close": F.lead("close").over(win.spec()), "_next_ts": F.lead("ts").over(win.spec()), "_end": F.last("ts").over(last)})
    t = df.where("direction <> 0").groupBy("symbol", "epoch").agg(
        F.first("direction").alias("direction"), F.min("ts").alias("entry_ts"), F.coalesce(F.max_by("_next_ts", "ts"), F.max("ts")).alias("exit_ts"), F.first("entry_price").alias("entry_price"),
        F.coalesce(F.max_by("_next_close", "ts"), F.max_by("close", "ts")).alias("exit_price"), F.first("epoch_capital").alias("_c"), F.count("*").alias("bars"), F.max_by(F.col("_next_ts").isNull(), "ts").alias("liquidated"),
    )
    t = t.withColumn("size", F.abs("_c") * a / F.col("entry_price") * F.col("direction"))
    pnl = (F.col("exit_price") - F.col("entry_price")) * F.col("size") - F.abs("size") * F.col("exit_price") * k
    t = t.withColumn("pnl", pnl).withColumn("return_pct", F.col("pnl") / F.nullif(F.abs(F.col("size") * F.col("entry_price")), F.lit(0.0)))
    return t.withColumn("days", F.datediff("exit_ts", "entry_ts").cast("long")).drop("_c")


def trade_metrics(t: DataFrame) -> DataFrame:
    p = F.col("pnl")
    gain, loss = F.coalesce(F.sum(F.when(p > 0, p)), F.lit(0.0)), F.coalesce(F.sum(F.when(p < 0, -p)), F.lit(0.0))
    return t.groupBy("symbol").agg(
        F.count("*").alias("num_trades"), F.avg((p > 0).cast("double")).alias("win_rate"),
        F.when(loss == 0, F.when(gain > 0, float("inf")).otherwise(0.0)).otherwise(gain / F.nullif(loss, F.lit(0.0))).alias("profit_factor"),
        F.avg(F.when(p > 0, p)).alias("avg_win"), F.avg(F.when(p < 0, p)).alias("avg_loss"), F.max(p).alias("largest_win"), F.min(p).alias("largest_loss"), F.sum(p).alias("total_pnl"),
        F.avg("days").alias("avg_days"), F.min("days").alias("min_days"), F.max("days").alias("max_days"), F.stddev_pop(p).alias("std_pnl"),
        F.percentile(p, F.array(*map(F.lit, (0.1, 0.25, 0.5, 0.75, 0.9)))).alias("pnl_percentiles"), F.avg("return_pct").alias("avg_trade_return"),
    )


def run_metrics(run: DataFrame, t: DataFrame, periods: float = 252) -> DataFrame:
    """The eight figures of a backtest."""
    df = run.withColumns({"_r": F.col("equity") / F.nullif(F.lag("equity").over(win.spec()), F.lit(0.0)) - 1, "_dd": F.col("equity") / F.nullif(F.max("equity").over(win.upto()), F.lit(0.0)) - 1})
    total = F.max_by("equity", "ts") / F.min_by("equity", "ts") - 1
    out = df.groupBy("symbol").agg(total.alias("total_return"), F.count("_r").alias("_n"), (F.stddev_samp("_r") * math.sqrt(periods)).alias("volatility"), F.min("_dd").alias("max_drawdown"))
    growth = F.col("total_return") + 1
    out = out.withColumn("annualized_return", F.when((growth > 0) & (F.col("_n") > 0), F.pow(growth, F.lit(float(periods)) / F.nullif(F.col("_n").cast("double"), F.lit(0.0))) - 1))
    out = out.withColumn("sharpe_ratio", F.when(F.col("volatility") > 0, F.col("annualized_return") / F.nullif("volatility", F.lit(0.0))).otherwise(0.0)).drop("_n")
    won = trade_metrics(t).select("symbol", "win_rate", "num_trades", "avg_trade_return")
    return out.join(won, "symbol", "left").na.fill(0, ["win_rate", "num_trades", "avg_trade_return"])


def pair_backtest(signals: DataFrame, capital: float = CAPITAL, risk: float | Column = 0.02) -> DataFrame:
    """Round trips of a pair rule: size from the capital, the first leg's variance and the legs' correlation; profit on the first leg at the exit.

    signals: a, b, signal, is_exit, var_a, corr_ab of one or more pairs.
    """
    marked = signals.where((F.col("signal") != 0) | F.col("is_exit"))
    budget = F.lit(capital) * risk
    size = budget / (F.sqrt("var_a") * 10 + 1) * F.abs("corr_ab") / F.col("a")
    marked = marked.withColumns({"_size": size, "_exit": F.lead("a").over(win.spec()), "_exit_ts": F.lead("ts").over(win.spec()), "_closes": F.lead("is_exit").over(win.spec())})
    done = marked.where((F.col("signal") != 0) & F.col("_closes"))
    pnl = (F.col("_exit") - F.col("a")) * F.col("_size") * F.col("signal")
    out = done.select("symbol", F.col("ts").alias("entry_ts"), F.col("_exit_ts").alias("exit_ts"), "signal", F.col("_size").alias("size"), pnl.alias("pnl"))
    return out.withColumn("equity", F.sum("pnl").over(Window.partitionBy("symbol").orderBy("entry_ts").rowsBetween(Window.unboundedPreceding, 0)) + capital)


def vector_backtest_in_blocks(signals: DataFrame, fee: float = 0.0, rows: int = BLOCK_ROWS) -> DataFrame:
    """vector_backtest with a symbol over many tasks: positions in blocks of rows, both equities by one scan of products."""
    lag = lambda c, n, w: F.coalesce(F.lag(c, n).over(w), F.lit(0))

    def positions(df: DataFrame, w) -> DataFrame:
        turn = F.abs(lag("signal", 1, w) - lag("signal", 2, w))
        return df.withColumn("strategy_ret", F.coalesce(lag("signal", 1, w) * F.col("ret"), F.lit(0.0)) - turn * fee)

    held = in_blocks(signals, 2, positions, rows=rows)
    growth = {"equity": "strategy_ret", "buy_hold": "ret"}
    return scan(time_blocks(held, rows=rows), {k: Running(F.coalesce(c, F.lit(0.0)) + 1, "product") for k, c in growth.items()})
