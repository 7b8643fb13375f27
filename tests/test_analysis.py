"""Whole analyses against their parts, and the pieces that SQL cannot express against plain versions."""

from __future__ import annotations

import inspect
import itertools
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions import windows as win
from barloom.operators import analysis as an
from barloom.operators import backtest as bt
from barloom.operators import metrics as m
from barloom.operators import optimize as opt
from barloom.operators import resample as rs
from barloom.operators import signals as sig
from barloom.operators import tests as ts
from barloom.sources.periods import in_period, named_period


@pytest.mark.parametrize(
    ("name", "start", "end"),
    [
        ("2024", "2024-01-01", "2025-01-01"), ("1999", "1999-01-01", "2000-01-01"), ("YTD", "2024-01-01", "2024-03-11"), ("1m", "2024-02-09", "2024-03-11"), ("last_6m", "2023-09-12", "2024-03-11"), ("1y", "2023-03-11", "2024-03-11"),
        ("2024-01-05, 2024-01-05", "2024-01-05", "2024-01-06"), ("whenever", "2023-09-12", "2024-03-11"),
    ],
)
def test_named_periods(name, start, end):
    assert named_period(name, date(2024, 3, 10)) == (datetime.fromisoformat(start), datetime.fromisoformat(end))


def test_period_that_ends_before_it_starts(spark):
    with pytest.raises(ValueError):
        named_period("2024-02-01,2024-01-01", date(2024, 3, 10))
    bars = spark.sql("select explode(sequence(timestamp_ntz'2024-01-01 00:00:00', timestamp_ntz'2024-01-03 23:00:00', interval 1 hour)) as ts")
    assert in_period(bars, "2024-01-02,2024-01-02", date(2024, 3, 10)).count() == 24


def test_bounds_hold_the_presets():
    assert set(sig.BOUNDS) == set(sig.RULES)
    for rule, held in sig.BOUNDS.items():
        presets = {k: v.default for k, v in inspect.signature(sig.RULES[rule]).parameters.items()}
        for name, (lo, hi) in held.items():
            assert lo <= presets[name] <= hi, (rule, name)


@pytest.fixture(scope="module")
def series(spark):
    r = np.random.default_rng(3)
    rows = [(s, t, float(x)) for s in "AB" for t, x in enumerate(r.normal(0.001, 0.02, 60))]
    return spark.createDataFrame(rows, "series string, t long, ret double").cache()


def path_stats(p):
    return m.simulation_metrics(p, ("series", "sim"), "t", 52).select("series", "sim", F.col("cumulative_return").alias("total_return"), "volatility", "sharpe", "max_drawdown")


METRICS = ["total_return", "volatility", "sharpe", "max_drawdown"]


def test_kernel_distance_by_hand(series):
    paths = rs.resample(series, 4, "iid", seed=1)
    values = lambda df, *keys: {k: [r.ret for r in v] for k, v in itertools.groupby(sorted(df.collect(), key=lambda r: (*[r[k] for k in keys], r.t)), key=lambda r: tuple(r[k] for k in keys))}
    own, drawn = values(series, "series"), values(paths, "series", "sim")
    for r in rs.mmd(series, paths).collect():
        x, y = own[(r.series,)], drawn[r.series, r.sim]
        gaps = [(a - b) ** 2 for a, b in itertools.combinations(x, 2)]
        width = 2 * float(np.median(gaps)) / (2 * np.log(len(x)))
        k = lambda u, v: float(np.exp(-((u - v) ** 2) / width))  # noqa: E731, B023
        n = len(x)
        same = lambda z: sum(k(a, b) for i, a in enumerate(z) for j, b in enumerate(z) if i != j) / (n * (n - 1))  # noqa: E731, B023
        value = same(x) + same(y) - 2 * sum(k(a, b) for a in x for b in y) / (n * n)
        assert r.mmd == pytest.approx(max(0.0, value) ** 0.5, abs=1e-9)


def test_all_tests_are_those_of_the_parts(series):
    st, own = path_stats(rs.resample(series, 50, "block", 5, 1)).cache(), path_stats(series.withColumn("sim", F.lit(0).cast("long")))
    got = {(r.series, r.test, r.subject): (r.statistic, r.p_value) for r in an.all_tests(series, st, own, METRICS, 500, 2).collect()}
    assert len({t for _, t, _ in got}) == 10
    for r in ts.adjust(ts.empirical_p(st, own, METRICS), "p_two_sided", ["series"], ["metric"]).collect():
        assert got[r.series, "empirical", r.metric][1] == pytest.approx(r.p_two_sided)
        assert got[r.series, "empirical_bonferroni", r.metric][1] == pytest.approx(min(1, r.p_two_sided * len(METRICS)))
        assert r.p_two_sided <= got[r.series, "empirical_bh", r.metric][1] <= got[r.series, "empirical_bonferroni", r.metric][1] + 1e-12
    for r in ts.kernel_tests(st.select("series", F.col("sim").alias("t"), F.col("sharpe").alias("ret")), ["ks_normal", "anderson_darling", "mann_whitney_zero"]).collect():
        assert got[r.series, r.test, "sharpe"] == pytest.approx((r.statistic, r.p_value), nan_ok=True)
    for r in ts.autocorrelation(series).collect():
        assert got[r.series, "ljung_box", f"lag {r.lag}"] == pytest.approx((r.ljung_box, r.p_value))
    for r in rs.sign_permutation(series, 500, 2).collect():
        assert got[r.series, "sign_permutation", "returns"] == pytest.approx((r.positive, r.p_two_sided))


def test_full_analysis_has_every_section(series):
    p = rs.resample(series, 30, "block", 5, 1)
    st, own = path_stats(p), path_stats(series.withColumn("sim", F.lit(0).cast("long")))
    whole = an.full_analysis(rs.intervals(st, METRICS), an.all_tests(series, st, own, METRICS, 200, 2), an.simulated_risk(st), [("wasserstein", rs.wasserstein(series, p), "distance"), ("mmd", rs.mmd(series, p), "mmd")])
    names = {(r.section, r.name) for r in whole.collect()}
    assert {s for s, _ in names} == {"simulation", "test", "risk", "distance"} and {n for s, n in names if s == "distance"} == {"wasserstein", "mmd"}
    assert whole.groupBy("series", "section", "name", "stat").count().where("count > 1").count() == 0


def test_edge_score_by_hand(spark):
    rows = [("best", 2.5, 0.6, 0.7, -0.05, True, 0.1, 0.2, 60, 90, "strong"), ("good", 1.2, 0.3, 0.56, -0.15, True, -0.1, 0.2, 25, 64, "moderate"), ("none", -1.0, -0.2, 0.4, -0.5, False, -1.0, -0.1, 3, 0, "none"), ("edge", 0.5, 0.0, 0.5, -0.3, False, 0.0, 0.1, 20, 12, "none")]
    row = spark.createDataFrame([r[:9] for r in rows], "series string, sharpe double, total_return double, win_rate double, max_drawdown double, is_significant boolean, ci_lower double, sim_mean double, num_trades int")
    got = {r.series: (r.edge_score, r.band) for r in an.edge_score_100(row).collect()}
    assert got == {r[0]: r[9:] for r in rows}


def test_composite_search_is_each_backtest_alone(spark):
    r = np.random.default_rng(5)
    b = 100 * np.exp(np.cumsum(r.normal(0, 0.01, 700)))
    gap = np.zeros(700)
    for k in range(1, 700):
        gap[k] = 0.9 * gap[k - 1] + r.normal(0, 0.01)
    a = b * np.exp(gap)
    start = datetime(2020, 1, 1).toordinal()
    rows = [("A/B", datetime.fromordinal(start + k), float(a[k]), float(b[k])) for k in range(700)]
    pair = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, a double, b double").cache()
    grid = opt.grid(spark, {"window": [20, 40], "z_entry": [1.0], "z_exit": [0.5], "te_window": [20, 30], "risk": [0.02]})
    found = {x.params_id: x for x in opt.composite_search(pair, grid).collect()}
    assert sorted(x.rank for x in found.values()) == [1, 2, 3, 4] and any(x.train_score > -999 for x in found.values())
    for p in grid.collect():
        for name, cut in (("train", "k <= 490"), ("validation", "k > 490")):
            part = pair.withColumn("k", F.row_number().over(win.spec())).where(cut).drop("k")
            rule = sig.composite_pair(part, p.window, p.te_window, p.z_entry, p.z_exit)
            before = win.rows(-30, -1)
            rule = rule.withColumns({"var_a": F.var_samp("ra").over(before), "corr_ab": F.corr("ra", "rb").over(before)})
            trades = bt.pair_backtest(rule, risk=p.risk).orderBy("entry_ts").collect()
            score = -999.0
            if len(trades) >= 5:
                equity = np.array([t.equity for t in trades])
                pnl = np.array([t.pnl for t in trades])
                ret = pnl / (equity - pnl)
                depth = (equity / np.maximum(100_000, np.maximum.accumulate(equity)) - 1).min()
                score = ret.mean() / ret.std(ddof=1) * 252**0.5 * 0.4 + (equity[-1] / 100_000 - 1) * 30 + 0.2 / (abs(depth) + 0.01) + (pnl > 0).mean() * 0.1
            assert found[p.params_id][f"{name}_score"] == pytest.approx(score, rel=1e-6)
