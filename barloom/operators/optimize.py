"""Parameter search: candidates are rows, so that a whole search is one plan."""

from __future__ import annotations

import itertools
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rng
from ..functions import windows as win
from . import backtest as bt
from . import indicators as ind
from . import metrics as m
from . import signals as sig
from .backtest import CAPITAL


def grid(spark: SparkSession, values: Mapping[str, Sequence]) -> DataFrame:
    """All combinations, numbered in the order of nested loops: params_id and one column for each name."""
    names = list(values)
    rows = [(i, *combo) for i, combo in enumerate(itertools.product(*values.values()))]
    kinds = ["double" if any(isinstance(v, float) for v in values[n]) else "string" if isinstance(values[n][0], str) else "int" for n in names]
    return spark.createDataFrame(rows, "params_id int, " + ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))


def random_subset(params: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """k of the combinations, the same for the same seed."""
    return params.orderBy(rng.draw("params_id", F.lit(0), seed), "params_id").limit(k)


def random_candidates(spark: SparkSession, space: Mapping[str, tuple], n: int, seed: int = 0) -> DataFrame:
    """n draws from a space of name -> (kind, a, b): uniform, log_uniform, normal, int, or choice with a list as a."""
    out = spark.range(n).withColumnRenamed("id", "params_id")
    for k, (name, (kind, a, *rest)) in enumerate(space.items()):
        b = rest[0] if rest else None
        u = rng.uniform("params_id", F.lit(k), seed)
        column = {
            "uniform": lambda: u * (b - a) + a,
            "log_uniform": lambda: F.exp(u * (math.log(b) - math.log(a)) + math.log(a)),
            "normal": lambda: rng.normal("params_id", F.lit(k), seed) * b + a,
            "int": lambda: (F.floor(u * (b - a + 1)) + a).cast("long"),
            "choice": lambda: F.element_at(F.array(*map(F.lit, a)), (F.floor(u * len(a)) + 1).cast("int")),
        }[kind]()
        out = out.withColumn(name, column)
    return out


def best(scored: DataFrame, keys: Sequence[str], score: str = "score", ordinal: str = "params_id") -> DataFrame:
    """The first best row of each group: scores that are no number count as the lowest, ties go to the lower ordinal."""
    safe = F.when(F.col(score).isNull() | F.isnan(score) | (F.abs(score) == float("inf")), float("-inf")).otherwise(F.col(score))
    rest = [c for c in scored.columns if c not in keys]
    top = scored.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(safe.alias("s"), (-F.col(ordinal)).alias("o"))).alias("b"))
    return top.select(*keys, "b.*")


def top(scored: DataFrame, k: int = 10, score: str = "score", ordinal: str = "params_id") -> DataFrame:
    return scored.orderBy(F.desc_nulls_last(score), ordinal).limit(k)


def folds(spark: SparkSession, n: int, start: int = 126, train: int = 252, test: int = 63, step: int = 63) -> DataFrame:
    """Walk-forward folds over n bars: fold, train_lo, train_hi, test_lo, test_hi (ends exclusive); the last test windows end with the bars."""
    rows, at = [], start
    while at + train < n:
        rows.append((len(rows), at, at + train, at + train, min(at + train + test, n)))
        at += step
    return spark.createDataFrame(rows, "fold int, train_lo long, train_hi long, test_lo long, test_hi long")


def in_folds(bars: DataFrame, start: int = 126, train: int = 252, test: int = 63, step: int = 63, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Each bar once for every fold and part that holds its ordinal t; the folds() of each key's own number of bars."""
    t = F.col("t")
    n = F.max("t").over(Window.partitionBy(*keys)) + 1
    first = F.greatest(F.lit(0), F.floor((t - (start + train + test)) / step) + 1)
    last = F.least(F.floor((t - start) / step), F.ceil((F.col("_n") - (start + train)) / step) - 1)
    held = bars.withColumn("_n", n).where((t >= start) & (last >= first))
    held = held.withColumn("fold", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    return held.withColumn("part", F.when(t < start + train + F.col("fold") * step, "train").otherwise("test")).drop("_n")


def ranked(scored: DataFrame, keys: Sequence[str], score: str = "score", ordinal: str = "params_id") -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last(score), ordinal)))


def stability(chosen: DataFrame, subjects: Sequence[str], out_of_sample: str = "oos", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """(keys, subject, mean, std, least, most, folds, positive_folds) over the folds of a walk: how steady the chosen parameters are, and how the score out of sample."""
    good = F.sum(F.when(F.col(out_of_sample) > 0, 1).otherwise(0)).over(Window.partitionBy(*keys))
    long = chosen.withColumn("_good", good).select(*keys, "_good", *[F.col(c).cast("double").alias(c) for c in subjects]).unpivot([*keys, "_good"], list(subjects), "subject", "value")
    return long.groupBy(*keys, "subject").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("least"), F.max("value").alias("most"), F.count("*").alias("folds"), F.max("_good").cast("long").alias("positive_folds")
    )


def composite_search(pair: DataFrame, params: DataFrame, train: float = 0.7, gate: float = 0.01, capital: float = CAPITAL, periods: float = 252, least_trades: int = 5) -> DataFrame:
    """params with train_score, validation_score, score (0.3 and 0.7 of them) and rank: the composite pair rule under every row of params.

    pair: (symbol, ts, a, b) of one pair. params: params_id, window, z_entry, z_exit, te_window and risk. The pair's bars are split once, the earlier ones to train. What depends on
    a window alone is found once for each window; every candidate then is a symbol of its own, so that all of them are traded in one plan, dealt by candidate.
    A candidate with fewer than least_trades trades in a part scores -999 there.
    """
    w = Window.partitionBy("symbol").orderBy("ts")
    base = pair.withColumns({"_n": F.count("*").over(Window.partitionBy("symbol")), "_k": F.row_number().over(w)})
    base = base.withColumn("part", F.when(F.col("_k") <= F.floor(F.col("_n") * train), "train").otherwise("validation")).withColumn("symbol", F.col("part"))
    base = base.withColumns({"t": F.row_number().over(w) - 1, "ra": win.simple_return("a"), "rb": win.simple_return("b")}).drop("_n", "_k")
    before = win.rows(-30, -1)
    rows = base.withColumns({"var_a": F.var_samp("ra").over(before), "corr_ab": F.corr("ra", "rb").over(before)})
    windows = sorted({r.window for r in params.select("window").distinct().collect()})  # the grid's own values
    te_windows = sorted({r.te_window for r in params.select("te_window").distinct().collect()})
    for n in windows:
        spread = ind.hedge_ratio(rows, "a", "b", n).withColumn(f"_z{n}", F.when(F.col("t") >= 2 * n - 1, win.zscore("spread", n, F.stddev_pop)))
        rows = spread.drop("hedge", "spread")
    for n in te_windows:
        te = sig.transfer_entropy(base, "ra", "rb", n).select("symbol", (F.col("t") + 1).alias("t"), F.col("te_xy").alias(f"_xy{n}"), F.col("te_yx").alias(f"_yx{n}"))
        rows = rows.join(te, ["symbol", "t"], "left")
    pick = lambda stem, values, column: F.coalesce(*[F.when(F.col(column) == n, F.col(f"{stem}{n}")) for n in values])
    long = rows.crossJoin(F.broadcast(params)).withColumn("symbol", F.concat_ws("#", "part", "params_id"))
    long = long.withColumns({"z": pick("_z", windows, "window"), "_xy": pick("_xy", te_windows, "te_window"), "_yx": pick("_yx", te_windows, "te_window")})
    z, ratio = F.col("z"), F.col("_xy") / (F.col("_yx") + 1e-8)
    open_ = F.greatest("_xy", "_yx") >= gate
    enter = F.when(open_ & (z > F.col("z_entry")) & (ratio < 1), -1).when(open_ & (z < -F.col("z_entry")) & (ratio > 1), 1)
    traded = bt.pair_backtest(sig.latched(long, enter, open_ & (F.abs("z") < F.col("z_exit"))), capital, F.col("risk"))

    ret, depth = F.col("pnl") / (F.col("equity") - F.col("pnl")), F.col("equity") / F.greatest(F.lit(capital), F.max("equity").over(Window.partitionBy("symbol").orderBy("entry_ts").rowsBetween(Window.unboundedPreceding, 0))) - 1
    figures = traded.withColumns({"ret": ret, "_depth": depth}).groupBy("symbol").agg(
        F.count("*").alias("trades"), m.sharpe(F.col("ret"), periods).alias("sharpe"), (F.max_by("equity", "entry_ts") / capital - 1).alias("total"), F.min("_depth").alias("depth"), F.avg((F.col("pnl") > 0).cast("double")).alias("won")
    )
    score = F.coalesce("sharpe", F.lit(0.0)) * 0.4 + F.col("total") * 100 * 0.3 + F.lit(1.0) / (F.abs("depth") + 0.01) * 0.2 + F.col("won") * 0.1
    figures = figures.withColumn("s", F.when(F.col("trades") >= least_trades, score).otherwise(-999.0))
    part = lambda name: figures.where(F.col("symbol").startswith(f"{name}#")).select(F.split_part("symbol", F.lit("#"), F.lit(2)).cast("int").alias("params_id"), F.col("s").alias(f"{name}_score"))
    out = params.join(part("train"), "params_id", "left").join(part("validation"), "params_id", "left").na.fill(-999.0, ["train_score", "validation_score"])
    out = out.withColumn("score", F.col("train_score") * 0.3 + F.col("validation_score") * 0.7)
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "params_id")))
