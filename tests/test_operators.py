from __future__ import annotations

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barloom.functions import rng, stats
from barloom.operators import backtest as bt
from barloom.operators import bayes, joins, optimize, validate
from barloom.operators import indicators as ind
from barloom.operators import metrics as m
from barloom.operators import portfolio as pf
from barloom.operators import resample as rs
from barloom.operators import signals as sig
from barloom.operators import tests as ts
from barloom.sources import bars as src
from barloom.sources import config, reports, synthetic

BARS = "symbol string, t int, close double"


def make_bars(spark, closes, symbol="X"):
    rows = [(symbol, i, float(c)) for i, c in enumerate(closes)]
    df = spark.createDataFrame(rows, BARS).withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.col("t")))
    return df.select("symbol", "ts", F.col("close").alias("open"), (F.col("close") * 1.01).alias("high"), (F.col("close") * 0.99).alias("low"), "close", F.lit(100.0).alias("volume"))


def walk(n, seed=1, scale=0.02, start=100.0):
    r = random.Random(seed)
    out = [start]
    for _ in range(n - 1):
        out.append(out[-1] * math.exp(r.gauss(0, scale)))
    return out


def test_required_columns(spark):
    with pytest.raises(ValueError, match="volume"):
        src.require_columns(spark.createDataFrame([(1.0,)], "close double"), ["close", "volume"])


def test_windows_are_null_until_full(spark):
    out = ind.enrich(make_bars(spark, walk(15))).orderBy("ts").collect()
    assert [r.sma10 is None for r in out] == [True] * 9 + [False] * 6
    assert all(r.sma20 is None for r in out)


def test_empty_bars(spark):
    empty = make_bars(spark, [1.0]).limit(0)
    assert ind.enrich(empty).count() == 0
    assert m.performance(ind.with_returns(empty)).count() == 0
    assert bt.event_backtest(sig.momentum(empty)).count() == 0


def test_one_bar_and_constant_prices(spark):
    assert sig.momentum(make_bars(spark, [5.0])).collect()[0].signal == 0
    flat = m.performance(ind.with_returns(make_bars(spark, [5.0] * 40))).collect()[0]
    assert flat.total_return == 0 and flat.sharpe is None and flat.max_drawdown == 0


def test_ema_is_the_weighted_mean(spark):
    closes = walk(60)
    out = [r.ema10 for r in ind.enrich(make_bars(spark, closes)).orderBy("ts").collect()]
    a, num, den = 1 - 2 / 11, 0.0, 0.0
    for c, got in zip(closes, out):
        num, den = c + a * num, 1 + a * den
        assert got == pytest.approx(num / den, rel=1e-12)


def test_drawdown_periods(spark):
    eq = make_bars(spark, [1, 2, 1, 1.5, 2.5, 2, 1]).withColumn("equity", F.col("close"))
    out = sorted(ind.drawdown_periods(eq).collect(), key=lambda r: r.start)
    assert [(r.bars, r.magnitude, r.recovered) for r in out] == [(2, -0.5, True), (2, -0.6, False)]


def by_hand_reversing(enter, a, b):
    pos, out = 0, []
    for e, x, y in zip(enter, a, b):
        if pos == 0:
            pos = e
        elif pos == 1 and x:
            pos = -1
        elif pos == -1 and y:
            pos = 1
        out.append(pos)
    return out


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([0, 0, 1, -1]), st.booleans(), st.booleans()), min_size=1, max_size=40))
def test_reversing_positions(spark, events):
    rows = [("X", i, *e) for i, e in enumerate(events)]
    df = spark.createDataFrame(rows, "symbol string, ts int, e int, a boolean, b boolean")
    out = sig.reversing(df, F.col("e"), F.col("a"), F.col("b")).orderBy("ts").collect()
    assert [r.position for r in out] == by_hand_reversing(*zip(*events))


@settings(max_examples=12, deadline=None)
@given(st.lists(st.sampled_from([(0, False), (1, False), (-1, False), (0, True)]), min_size=1, max_size=40))
def test_latched_positions(spark, events):
    rows = [("X", i, *e) for i, e in enumerate(events)]
    out = sig.latched(spark.createDataFrame(rows, "symbol string, ts int, e int, l boolean"), F.col("e"), F.col("l")).orderBy("ts").collect()
    pos, want = 0, []
    for e, leave in events:
        if pos == 0 and e:
            pos = e
        elif pos and leave:
            pos = 0
        want.append(pos)
    assert [r.position for r in out] == want


@pytest.mark.parametrize("compat", [False, True])
def test_algebra_equals_the_loop(spark, compat):
    run = sig.momentum(make_bars(spark, walk(200, 3)), 5, 0.01)
    fast = [r.equity for r in bt.algebra(run, 0.001, 0.0001, 0.95, 1e5, compat).orderBy("ts").collect()]
    slow = bt._walk(run.toPandas(), 0.0011, 0.95, 1e5, compat)["equity"].tolist()
    assert fast == pytest.approx(slow, rel=1e-10)


def test_used_up_accounts_are_walked(spark):
    closes = [100, 90, 80, 300, 900, 20, 10, 500, 5, 4, 3]
    run = sig.momentum(make_bars(spark, closes), 1, 0.01)
    got = [r.equity for r in bt.event_backtest(run).orderBy("ts").collect()]
    assert got == pytest.approx(bt._walk(run.toPandas(), 0.0011, 0.95, 1e5, False)["equity"].tolist(), rel=1e-10)


def test_rules_do_not_look_ahead(spark):
    bars = make_bars(spark, walk(160, 9))
    for name in ("volume_momentum", "mean_reversion", "statistical_arbitrage", "donchian", "pairs"):
        assert sig.look_ahead_violations(bars, sig.RULES[name], [70, 120]).count() == 0, name


def test_asof_over_blocks(spark):
    """A hot key over many days, with days that have no right row, ties, null keys and null times."""
    from datetime import datetime, timedelta

    r = random.Random(1)
    start = datetime(2024, 1, 1)
    when = lambda: start + timedelta(hours=r.randrange(24 * 20))
    lefts = [(r.choice(["hot", "hot", "a", None]), when() if r.random() > 0.05 else None, k) for k in range(300)]
    rights = [(r.choice(["hot", "a", None]), when(), r.randrange(100)) for _ in range(25)]
    left, right = spark.createDataFrame(lefts, "k string, ts timestamp_ntz, v int"), spark.createDataFrame(rights, "k string, ts timestamp_ntz, x int")
    got = {x.v: x.x for x in joins.asof(left, right, ["k"], "ts", ["x"]).collect()}
    want = {v: max(((t, x) for k2, t, x in rights if k2 == k and ts and t <= ts), default=(None, None))[1] for k, ts, v in lefts}
    assert got == want


@pytest.mark.parametrize("block", [2, 1024])
def test_covariance_of_incomplete_series(spark, block):
    import pandas as pd

    r = np.random.default_rng(2)
    wide = pd.DataFrame(r.normal(0.001, 0.02, (80, 5)), columns=list("ABCDE"))
    wide = wide.mask(r.random((80, 5)) < 0.3)
    wide["E"] = wide["E"].where(wide.index < 1)
    rows = [(c, int(t), None if pd.isna(v) else float(v)) for c in wide for t, v in wide[c].items()]
    cov, corr = wide.cov() * 252, wide.corr()
    for x in m.covariance(spark.createDataFrame(rows, "symbol string, ts long, ret double"), block=block).collect():
        assert x.i <= x.j
        for got, want in ((x["cov"], cov.loc[x.i, x.j]), (x["corr"], corr.loc[x.i, x.j])):
            assert (got is None and pd.isna(want)) or got == pytest.approx(want, rel=1e-9)


def test_asof(spark):
    left = spark.createDataFrame([(1, 5, "a"), (1, 1, "b"), (2, 9, "c")], "k int, ts int, v string")
    right = spark.createDataFrame([(1, 2, 20), (1, 5, 50), (1, 7, 70)], "k int, ts int, x int")
    out = {r.v: r.x for r in joins.asof(left, right, ["k"], "ts", ["x"]).collect()}
    assert out == {"a": 50, "b": None, "c": None}


def test_generator_is_uniform_and_the_same_everywhere(spark):
    u = [r.u for r in spark.range(20_000).repartition(7).select(rng.uniform("id", F.lit(3), 5).alias("u")).collect()]
    assert 0.49 < np.mean(u) < 0.51 and abs(np.std(u) - 0.2887) < 0.01
    z = [r.z for r in spark.range(20_000).select(rng.normal("id", F.lit(3), 5).alias("z")).collect()]
    assert abs(np.mean(z)) < 0.03 and abs(np.std(z) - 1) < 0.03


def test_block_bootstrap_keeps_blocks(spark):
    series = spark.createDataFrame([("X", i, float(i)) for i in range(50)], "series string, t long, ret double")
    rows = rs.resample(series, 3, "block", 10, 1).orderBy("sim", "t").collect()
    for i in range(0, len(rows), 10):
        block = [r.ret for r in rows[i : i + 10]]
        assert np.diff(block).tolist() == [1.0] * 9
    perm = rs.permute(series, 2, 5, 1).groupBy("sim").agg(F.sum("ret").alias("s")).collect()
    assert [r.s for r in perm] == [1225.0, 1225.0]
    with pytest.raises(ValueError):
        rs.resample(series, 1, "other")


def test_distribution_functions():
    assert stats.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert stats.chi2_sf(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)
    assert stats.kolmogorov_sf(0.0, 10) == 1.0
    x = np.random.default_rng(0).normal(size=300)
    assert stats.shapiro(x)[1] > 0.01 and stats.shapiro(np.exp(x))[1] < 1e-6
    assert stats.ks_normal(x)[1] > 0.05 and stats.ks_uniform(x)[1] < 0.01
    assert stats.anderson_darling(x)[0] < stats.anderson_darling(x)[1] < stats.anderson_darling(np.exp(x))[0]
    assert stats.wilcoxon(x + 1)[1] < 1e-6 and stats.mann_whitney(x, x + 1)[1] < 1e-6
    assert stats.ranks(np.array([3.0, 1.0, 3.0])).tolist() == [2.5, 1.0, 2.5]
    arch = np.random.default_rng(1).normal(size=600) * np.repeat([1, 5] * 15, 20)
    assert stats.arch_lm(arch)[1] < 0.01
    assert math.isnan(stats.wilcoxon([1, 2])[0])


def test_adjusted_p_values(spark):
    p = spark.createDataFrame([("a", 0.01), ("b", 0.02), ("c", 0.03), ("d", 0.5)], "h string, p_value double")
    out = {r.h: r for r in ts.adjust(p).collect()}
    assert out["a"].bonferroni == pytest.approx(0.04) and out["a"].bh == pytest.approx(0.04) and out["d"].bh == pytest.approx(0.5)


def test_portfolios_meet_their_conditions():
    r = np.random.default_rng(2).normal(size=(400, 5)) * [1, 2, 3, 1.5, 0.5]
    cov, mu = np.cov(r.T), np.array([0.1, 0.3, 0.2, 0.15, 0.05])
    w = pf.minimum_variance(cov)
    g = cov @ w
    assert w.sum() == pytest.approx(1) and (w >= 0).all() and g[w > 1e-6].max() - g[w > 1e-6].min() < 1e-6 and (g[w <= 1e-6] >= g[w > 1e-6].min() - 1e-6).all()
    assert pf.minimum_variance(cov, 0.4).max() <= 0.4 + 1e-9
    rp = pf.risk_parity(cov)
    shares = rp * (cov @ rp)
    assert shares.max() / shares.min() < 1 + 1e-6
    assert pf.target_return(cov, mu, 0.2) @ mu == pytest.approx(0.2, abs=1e-3)
    h = pf.hierarchical_risk_parity(cov)
    assert h.sum() == pytest.approx(1) and (h > 0).all()
    best = pf.maximum_sharpe(cov, mu)
    score = lambda w: (w @ (mu - 0.02)) / math.sqrt(w @ cov @ w)
    assert all(score(best) >= score(np.random.default_rng(k).dirichlet(np.ones(5))) - 1e-9 for k in range(200))
    assert np.abs(pf.kelly(np.zeros((2, 2)), np.ones(2))).sum() == pytest.approx(1)
    with pytest.raises(ValueError):
        pf.project(np.ones(2), 0.4)


def test_search(spark):
    scored = spark.createDataFrame([("s", 0, 1.0), ("s", 1, 3.0), ("s", 2, 3.0), ("s", 3, float("inf")), ("s", 4, None)], "symbol string, params_id int, score double")
    assert optimize.best(scored, ["symbol"]).collect()[0].params_id == 1
    assert optimize.folds(spark, 126 + 252 + 63).count() == 1
    found = bayes.search(lambda xs: [-((x[0] - 3) ** 2) for x in xs], [(0, 10)], rounds=6, batch=3, seed=1)
    assert max(s for _, s in found) > -0.3


def test_folds_reach_the_last_bar(spark):
    sizes = {"a": 378, "b": 379, "c": 720, "d": 1000}
    bars = spark.createDataFrame([(s, t) for s, n in sizes.items() for t in range(n)], "symbol string, t int")
    got = sorted(map(tuple, optimize.in_folds(bars).select("symbol", "fold", "part", "t").collect()))
    want = []
    for s, n in sizes.items():
        for f in optimize.folds(spark, n).collect():
            want += [(s, f.fold, "train", t) for t in range(f.train_lo, f.train_hi)] + [(s, f.fold, "test", t) for t in range(f.test_lo, f.test_hi)]
    assert got == sorted(want)
    assert {s: max((t for x, _, _, t in got if x == s), default=None) for s in sizes} == {"a": None, "b": 378, "c": 719, "d": 999}


def test_mann_whitney_of_two_samples(spark):
    from barloom.functions import stats
    from barloom.operators import tests as ts

    data = {"a": ([0.1, 0.2, 0.2, 0.5, -1.0], [0.2, 0.3, 0.9]), "b": ([1.0, 1.0], [1.0]), "c": ([3.0, 4.0, 5.0, 6.0], [0.0, 1.0, 2.0])}
    rows = [(s, p, x) for s, two in data.items() for p, xs in zip(("in", "out"), two) for x in xs] + [("a", "in", None), ("d", "in", 1.0)]
    got = {r.series: (r.statistic, r.p_value) for r in ts.mann_whitney_two_sample(spark.createDataFrame(rows, "series string, part string, ret double"), "part", "in", "out", keys=["series"]).collect()}
    assert set(got) == set(data)
    for s, (x, y) in data.items():
        wins = sum((p > q) + (p == q) / 2 for p in x for q in y)
        assert got[s] == pytest.approx((wins, stats.mann_whitney(x, y)[1]))


def test_checks(spark):
    bad = spark.createDataFrame([("X", None), ("X", float("inf")), ("X", -2.0)], "symbol string, ret double")
    failed = {r.check for r in validate.returns(bad).where("failed").collect()}
    assert {"nulls", "infinite", "too_few", "above_100_percent", "below_minus_100_percent"} <= failed
    assert validate.correlation(np.array([[1, 2], [2, 1]])) == ["out of range", "not positive semidefinite"]
    assert validate.parameters({"lookback": 100}, sig.BOUNDS["momentum"]) == ["threshold is missing", "lookback = 100 is not in [5, 50]"]


def test_profiles_and_reports(spark):
    assert config.profile("production").n_sims == 1000
    assert config.validation_profile(config.profile("quick_test")).n_sims == 50
    assert config.load_profiles("p: {n_sims: 5, batch_size: 1, block_length: 2, method: IID}")["p"].method == "iid"
    with pytest.raises(ValueError):
        config.load_batch("strategies: [a]")
    df = spark.createDataFrame([("<x>", 1.5)], "a string, b double")
    assert "| <x> | 1.5000 |" in reports.markdown("T", {"s": df}) and "&lt;x&gt;" in reports.html_page("T", {"s": df})
    with pytest.raises(ValueError):
        reports.markdown("T", {"s": spark.range(10)}, most=5)


def test_synthetic_bars_are_bars(spark):
    out = synthetic.benchmarks(spark, 80).collect()
    assert len(out) == 400 and all(r.low <= min(r.open, r.close) and r.high >= max(r.open, r.close) for r in out)


def test_csv_without_a_time_column(spark, tmp_path):
    (tmp_path / "x.csv").write_text("Open,Close\n1,2\n")
    with pytest.raises(ValueError, match="no time column"):
        src.read_csv_bars(spark, str(tmp_path / "x.csv"), "X")
