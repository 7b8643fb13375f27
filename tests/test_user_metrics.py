"""A user's metrics equal their built-in twins."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import blocks as bl
from barloom.operators import metrics as m
from barloom.operators import resample as rs
from barloom.operators import user_metrics as um


def drawdown(x):
    equity = np.cumprod(1 + x)
    return float((equity / np.maximum.accumulate(equity) - 1).min())


@pytest.fixture(scope="module")
def series(spark):
    r = np.random.default_rng(1)
    rows = [(s, t, float(x)) for s in "ab" for t, x in enumerate(r.normal(0.001, 0.02, 70))]
    return spark.createDataFrame(rows, "series string, t long, ret double").repartition(3)


def test_measures_equal_the_bundle(series):
    paths = rs.permute(series, 12, 1, 5)
    wanted = {(x.series, x.sim): (x.max_drawdown, x.volatility) for x in m.simulation_metrics(paths, ("series", "sim"), "t", 52).collect()}
    by_array = um.measure(paths, um.ArrayMetric(drawdown), ("series", "sim"))
    by_column = um.measure(paths, um.ColumnMetric(lambda c: F.stddev_samp(c) * math.sqrt(52)), ("series", "sim"))
    for k, found in enumerate((by_array, by_column)):
        rows = found.collect()
        assert len(rows) == len(wanted) == 24
        assert all(math.isclose(x["value"], wanted[x.series, x.sim][k], rel_tol=1e-9) for x in rows)


def test_permutation_of_what_has_no_order(series):
    """A metric that ignores the order is the same in every permutation: both p-values are 1."""
    for metric in (um.ColumnMetric(F.stddev_samp), um.ArrayMetric(lambda x: float(np.sort(x)[3]))):
        for x in um.permutation_test(series, metric, 9).collect():
            assert (x.n_sims, x.p_greater, x.p_less) == (9, 1.0, 1.0)


def test_intervals(series):
    metric = um.ArrayMetric(lambda x: float(x.mean()))
    mine = {x.series: (x["mean"], x.lo, x.hi) for x in um.bootstrap_interval(series, metric, 60, "iid", seed=3).collect()}
    twin = {x.series: (x["mean"], x.lo, x.hi) for x in um.bootstrap_interval(series, um.ColumnMetric(F.avg), 60, "iid", seed=3).collect()}
    for s in "ab":
        assert np.allclose(mine[s], twin[s], rtol=1e-9)


def test_rolling(spark):
    r = np.random.default_rng(2)
    rows = [(s, t, None if t == 15 else float(x)) for s in "ab" for t, x in enumerate(r.normal(0, 0.02, 40))]
    df = spark.createDataFrame(rows, "symbol string, ts long, ret double")
    mine = um.rolling_metric(df, um.ArrayMetric(drawdown), 7, name="mine")
    both = bl.with_rolling_drawdown(mine, 7, name="twin").collect()
    assert sum(x.mine is not None for x in both) == 2 * (40 - 6 - 7)
    assert all((x.mine is None) == (x.twin is None) and (x.mine is None or math.isclose(x.mine, x.twin, rel_tol=1e-9, abs_tol=1e-15)) for x in both)
    mean = um.rolling_metric(df, um.ColumnMetric(F.avg), 7, name="mean").where("mean is not null")
    assert mean.count() == 2 * (40 - 6 - 7)
