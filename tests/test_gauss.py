"""Fast Gauss transforms against direct sums, and the kernel distance of paths over tasks."""

from __future__ import annotations

import math
import time

import numpy as np
import pytest

from barloom.functions.gauss import Moments, median_squared_difference, pair_sum
from barloom.operators import resample as rs


def direct(a, b, length):
    return float(np.exp(-np.square(np.subtract.outer(a, b) / length)).sum())


R = np.random.default_rng(12)
SAMPLES = {
    "normal": R.normal(size=400), "ties": np.round(R.normal(size=300), 1), "tails": R.standard_cauchy(300), "one": np.array([0.3]), "same": np.zeros(50), "apart": np.r_[R.normal(size=100), 1e6 + R.normal(size=100)], "edges": np.arange(-50, 50) * 0.25,
}


@pytest.mark.parametrize("length", [0.01, 0.3, 1.0, 40.0])
@pytest.mark.parametrize("a", SAMPLES)
@pytest.mark.parametrize("b", ["normal", "tails", "edges"])
def test_pair_sums(a, b, length):
    x, y = SAMPLES[a], SAMPLES[b]
    found = pair_sum(Moments(x, length), Moments(y, length))
    assert math.isclose(found, direct(x, y, length), rel_tol=1e-10, abs_tol=1e-10 * len(x) * len(y))


@pytest.mark.parametrize("name", SAMPLES)
def test_median_of_squared_differences(name):
    x = SAMPLES[name]
    want = float(np.median(np.square(np.subtract.outer(x, x))[np.triu_indices(len(x), 1)])) if len(x) > 1 else 0.0
    assert math.isclose(median_squared_difference(x), want, rel_tol=1e-9, abs_tol=1e-15)


def test_time_is_near_linear():
    x, y = R.normal(size=100_000), R.normal(size=100_000)
    began = time.process_time()
    found = pair_sum(Moments(x, 0.1), Moments(y, 0.1)) / 1e10
    assert time.process_time() - began < 2
    # two normal samples: the difference has variance 2, so the mean kernel is 1 / sqrt(1 + 2 * 2 / 0.1^2)
    assert math.isclose(found, 1 / math.sqrt(1 + 4 / 0.01), rel_tol=0.02)


@pytest.mark.parametrize("limit", [4_000_000, 0])
def test_distance_of_paths(spark, limit, monkeypatch):
    monkeypatch.setattr(rs, "BROADCAST_VALUES", limit)
    series = {"a": R.normal(0, 0.02, 90), "b": R.normal(0.001, 0.05, 40), "two": np.array([0.1, 0.2])}
    own = spark.createDataFrame([(s, t, float(v)) for s, x in series.items() for t, v in enumerate(x)], "series string, t long, ret double")
    drawn = {(s, k): R.choice(x, len(x)) for s, x in series.items() for k in range(4)}
    paths = spark.createDataFrame([(s, k, t, float(v)) for (s, k), y in drawn.items() for t, v in enumerate(y)], "series string, sim long, t long, ret double")
    for r in rs.mmd(own, paths).collect():
        x, y = series[r.series], drawn[r.series, r.sim]
        n = len(x)
        s2 = float(np.median(np.square(np.subtract.outer(x, x))[np.triu_indices(n, 1)])) / (2 * math.log(n))
        s2 = s2 if s2 > 1e-9 else 1.0
        k = lambda a, b: direct(a, b, math.sqrt(2 * s2))  # noqa: B023, E731
        want = math.sqrt(max(0.0, (k(x, x) - n) / (n * (n - 1)) + (k(y, y) - n) / (n * (n - 1)) - 2 * k(x, y) / (n * n)))
        assert math.isclose(r.mmd, want, rel_tol=1e-5, abs_tol=1e-6)


def test_flips_are_fair_and_whole(spark):
    """Every flip of m is drawn once: heads lie between 0 and m, and vary as m fair coins do."""
    for m in (1, 22, 43, 64, 65, 300):
        sims = spark.range(4000).selectExpr("id as sim", f"explode(sequence(0L, {(m - 1) // 64}L)) as w")
        heads = np.array([r.h for r in sims.withColumn("h", rs._heads(sims.sim, sims.w, m - sims.w * 64, 3)).groupBy("sim").sum("h").withColumnRenamed("sum(h)", "h").collect()])
        assert heads.min() >= 0 and heads.max() <= m
        assert abs(heads.mean() - m / 2) < 5 * math.sqrt(m / 4 / 4000) and abs(heads.var() / (m / 4) - 1) < 0.12
