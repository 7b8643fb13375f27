"""Metrics of a user's own, in permutation tests, bootstraps and rolling windows.

A metric is either an aggregate over a column, which Spark computes as it does its own, or a function of a NumPy array of one path's values in their order,
which runs in Arrow batches, a path at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import windows as win
from . import resample as rs


@dataclass(frozen=True)
class ColumnMetric:
    """An aggregate; it must not depend on the order of the values."""

    build: Callable[[Column], Column]

    def column(self, value: Column, order: Column) -> Column:
        return self.build(value)


@dataclass(frozen=True)
class ArrayMetric:
    """A function of the values in order; None or NaN is null. Nulls among the values reach it as NaN."""

    f: Callable[[np.ndarray], float]

    def column(self, value: Column, order: Column) -> Column:
        f = self.f

        @F.pandas_udf("double")
        def run(v: pd.Series, t: pd.Series) -> float:
            out = f(v.to_numpy(dtype=float)[np.argsort(t.to_numpy(), kind="stable")])
            return float("nan") if out is None else float(out)

        return F.nanvl(run(value, order), F.lit(None).cast("double"))


Metric = ColumnMetric | ArrayMetric


def measure(paths: DataFrame, metric: Metric, keys: Sequence[str], value: str = "ret", order: str = "t", name: str = "value") -> DataFrame:
    """(keys, name): the metric of every path."""
    return paths.groupBy(*keys).agg(metric.column(F.col(value), F.col(order)).alias(name))


def permutation_test(series: DataFrame, metric: Metric, n_sims: int, block: int = 1, seed: int = 0, same: float = 1e-12) -> DataFrame:
    """(series, observed, n_sims, p_greater, p_less): where the metric of a series lies among those of its values in drawn orders, with the +1 correction."""
    drawn = measure(rs.permute(series, n_sims, block, seed), metric, ("series", "sim"))
    observed = measure(series, metric, ("series",), name="observed")
    v, x = F.col("value"), F.col("observed")
    p = lambda c: (F.count_if(c) + 1) / (F.count("*") + 1)
    return drawn.join(observed, "series").groupBy("series", "observed").agg(F.count("*").alias("n_sims"), p(v >= x - same).alias("p_greater"), p(v <= x + same).alias("p_less"))


def bootstrap_interval(series: DataFrame, metric: Metric, n_sims: int, method: str = "iid", block: int = 20, seed: int = 0, level: float = 0.95) -> DataFrame:
    """(series, mean, lo, hi) of the metric over resampled paths."""
    drawn = measure(rs.resample(series, n_sims, method, block, seed), metric, ("series", "sim"))
    return rs.intervals(drawn, ["value"], level).drop("metric", "p_positive")


def rolling_metric(returns: DataFrame, metric: Metric, n: int, value: str = "ret", name: str = "rolling", keys: Sequence[str] = win.KEYS, order: str = win.ORDER) -> DataFrame:
    """returns with the metric of every full frame of n values."""
    w = Window.partitionBy(*keys).orderBy(order)
    numbered = returns.withColumn("_nth", F.row_number().over(w))
    frame = w.rowsBetween(1 - n, 0)
    out = numbered.withColumns({"_seen": F.count(value).over(frame)}).withColumn("_metric", metric.column(F.col(value), F.col("_nth")).over(frame) if isinstance(metric, ColumnMetric) else _over(metric, value, frame))
    return out.withColumn(name, F.when(F.col("_seen") == n, F.col("_metric"))).drop("_nth", "_seen", "_metric")


def _over(metric: ArrayMetric, value: str, frame) -> Column:
    """Rows of a bounded frame come in its order."""
    f = metric.f

    @F.pandas_udf("double")
    def run(v: pd.Series) -> float:
        out = f(v.to_numpy(dtype=float))
        return float("nan") if out is None else float(out)

    return run(F.col(value)).over(frame)
