"""Exact quantiles under small limits, and rank tests against kernels that hold a whole series."""

from __future__ import annotations

import math

import numpy as np
import pytest

from barloom.operators import quantiles as qs
from barloom.operators import ranks as rk
from barloom.operators import tests as ts

FRACTIONS = (0.0, 0.01, 0.5, 0.9, 1.0)


@pytest.fixture(scope="module")
def groups():
    r = np.random.default_rng(6)
    return {
        "normal": r.normal(size=30_000),
        "ties": r.integers(0, 40, 20_000).astype(float),
        "hot": np.where(r.random(20_000) < 0.9, 1.5, r.normal(size=20_000)),  # nine rows in ten have one value
        "two": np.repeat([1.0, 2.0], 5000),
        "tails": r.standard_cauchy(10_000) ** 3,
        "few": np.array([3.0, 1.0, 2.0]),
        "one": np.array([5.0]),
    }


def frame(spark, groups):
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("few", None), ("few", math.nan), ("none", None)]
    return spark.createDataFrame(rows, "symbol string, ret double").repartition(6)


@pytest.mark.parametrize("limit", [50, 3000, 100_000])
def test_exact_quantiles(spark, groups, limit):
    found = {(r.symbol, r.fraction): (r.n, r.quantile) for r in qs.exact_quantiles(frame(spark, groups), FRACTIONS, limit=limit).collect()}
    assert len(found) == len(groups) * len(FRACTIONS)
    for k, v in groups.items():
        for q in FRACTIONS:
            n, value = found[k, q]
            assert n == len(v) and math.isclose(value, np.quantile(v, q), rel_tol=1e-12, abs_tol=1e-15), (k, q)


def test_historical_tails(spark, groups):
    found = {(r.symbol, r.level): (r["var"], r.cvar) for r in qs.historical_tails(frame(spark, groups), (0.9, 0.99), limit=100).collect()}
    for k, v in groups.items():
        for level in (0.9, 0.99):
            cut = np.quantile(v, 1 - level)
            assert math.isclose(found[k, level][0], cut, rel_tol=1e-9, abs_tol=1e-12)
            assert math.isclose(found[k, level][1], v[v <= found[k, level][0]].mean(), rel_tol=1e-9, abs_tol=1e-12)


def test_no_rows(spark):
    none = spark.createDataFrame([], "symbol string, ret double")
    assert qs.exact_quantiles(none, FRACTIONS).count() == 0
    assert rk.rank_tests(none, key="symbol").count() == 0


def test_global_ranks(spark, groups):
    found = {}
    for r in rk.global_ranks(frame(spark, groups).where("not isnan(ret)"), "ret", ["symbol"]).collect():
        found.setdefault(r.symbol, {})[r.ret] = (r.n, r.below)
    for k, v in groups.items():
        s = np.sort(v)
        assert found[k] == {x: (int((s == x).sum()), int(np.searchsorted(s, x))) for x in set(v.tolist())}


def test_rank_tests_equal_kernels(spark):
    r = np.random.default_rng(9)
    series = {"a": r.normal(0.1, 1, 400), "b": np.round(r.normal(0, 1, 300), 1), "flat": np.zeros(20), "short": np.array([1.0, 2.0, -1.0]), "one": np.array([2.0]), "shift": r.exponential(1, 500)}
    df = spark.createDataFrame([(k, i, float(x)) for k, v in series.items() for i, x in enumerate(v)], "series string, t long, ret double")
    names = ["ks_normal", "ks_uniform", "anderson_darling", "wilcoxon", "mann_whitney_zero"]
    found = {(x.series, x.test): (x.statistic, x.p_value) for x in rk.rank_tests(df).collect()}
    wanted = {(x.series, x.test): (x.statistic, x.p_value) for x in ts.kernel_tests(df, names).collect()}
    assert set(found) == set(wanted)
    for key, pair in wanted.items():
        for a, b in zip(found[key], pair):
            assert (a is None and b is None) or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12), (key, found[key], pair)


def test_two_samples_equal_the_plain_windows(spark):
    r = np.random.default_rng(11)
    rows = [(s, str(r.choice(["in", "out", "other"])), float(np.round(x, 2))) for s in "ab" for x in r.normal(size=500)]
    df = spark.createDataFrame(rows, "series string, part string, ret double")
    for mine, plain in ((rk.ks_two_sample, ts.ks_two_sample), (rk.mann_whitney_two_sample, ts.mann_whitney_two_sample)):
        a = {x.series: x[1:] for x in mine(df, "part", "in", "out").collect()}
        b = {x.series: x[1:] for x in plain(df, "part", "in", "out", keys=["series"]).collect()}
        assert set(a) == set(b)
        for k in a:
            assert np.allclose(a[k], b[k], rtol=1e-9, atol=1e-12)
