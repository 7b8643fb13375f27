"""Blocks of a series against the whole series."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions import windows as win
from barloom.functions.wavelet import WaveletMatrix, rolling_tail
from barloom.operators import blocks
from barloom.operators import indicators as ind

SCHEMA = "symbol string, t0 long, ret double"


def frame(spark, series):
    """One long series, one short, one of one row; nulls within."""
    return spark.createDataFrame([(s, i, v) for s, values in series.items() for i, v in values], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def series():
    r = random.Random(2)
    long = [(3 * i + r.randrange(3), None if r.random() < 0.05 else r.gauss(0.001, 0.03)) for i in range(2000)]
    burst = [(i if i < 700 else 10_000 + 50 * i, r.gauss(0, 0.01)) for i in range(900)]
    return {"long": long, "burst": burst, "short": [(i, 0.1) for i in range(4)], "one": [(7, None)]}


def plain_path(values):
    eq, peak, out = 1.0, None, []
    for v in values:
        eq *= 1 + (v or 0.0)
        peak = eq if peak is None else max(peak, eq)
        out.append((eq, peak, eq / peak - 1 if peak else None))
    return out


def collected(df, *names):
    out = {}
    for r in df.orderBy("symbol", "t0").collect():
        out.setdefault(r.symbol, []).append(tuple(r[n] for n in names))
    return out


def close(a, b):
    return (a is None and b is None) or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12))


def same(found, wanted):
    assert set(found) == set(wanted)
    for s in wanted:
        assert len(found[s]) == len(wanted[s])
        for a, b in zip(found[s], wanted[s]):
            assert all(map(close, a, b)), (s, a, b)


@pytest.mark.parametrize("rows", [1, 7, 300, 100_000])
def test_equity_path(spark, series, rows):
    found = collected(blocks.equity_path(frame(spark, series), order="t0", rows=rows), "equity", "peak", "drawdown")
    same(found, {s: plain_path([v for _, v in x]) for s, x in series.items()})


def test_equity_path_through_zero_and_below(spark):
    values = [0.5, -3.0, 0.2, -0.5, 1.0, -1.0, 0.3, 0.4]
    for rows in (1, 2, 3, 100):
        found = collected(blocks.equity_path(frame(spark, {"a": list(enumerate(values))}), order="t0", rows=rows), "equity", "peak", "drawdown")
        same(found, {"a": plain_path(values)})


@pytest.mark.parametrize("rows", [7, 300])
def test_scan_and_numbers(spark, series, rows):
    df = frame(spark, series)
    runs = {"total": blocks.Running(F.col("ret"), "sum"), "most": blocks.Running(F.col("ret"), "max"), "least": blocks.Running(F.col("ret"), "min"), "now": blocks.Running(F.col("ret"), "last")}
    found = collected(blocks.scan(blocks.time_blocks(df, order="t0", rows=rows), runs, order="t0"), *runs)
    w = win.upto(win.ordered(("symbol",), "t0"))
    wanted = collected(df.withColumns({"total": F.sum("ret").over(w), "most": F.max("ret").over(w), "least": F.min("ret").over(w), "now": F.last("ret", ignorenulls=True).over(w)}), *runs)
    same(found, wanted)
    assert collected(blocks.number_rows(df, order="t0", rows=rows), "t") == {s: [(i,) for i in range(len(x))] for s, x in series.items()}


def test_windows_have_a_block_key(spark, series):
    """No window over a symbol's rows alone: those by symbol hold one row a block."""
    plan = blocks.equity_path(frame(spark, series), order="t0", rows=300)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows
    for line in windows:  # [values], [partition], [order]: a window by symbol alone is in the order of blocks, of which each has one row there
        partition, order = line.rsplit("], [", 2)[1:]
        assert "_block" in partition or "_block" in order, line


@pytest.mark.parametrize("rows", [64, 500])
def test_ema_in_blocks(spark, series, rows):
    spans = {"e3": ("ret", 3), "e20": ("ret", 20)}
    before = max(1 << win.ema_span(n).bit_length() for _, n in spans.values())
    found = collected(blocks.in_blocks(frame(spark, series), before, lambda d, w: blocks.with_ema(d, spans, w), order="t0", rows=rows), *spans)
    wanted = {}
    for s, x in series.items():
        cols = []
        for _, n in spans.values():
            d, num, den, out = 1 - 2 / (n + 1), 0.0, 0.0, []
            for _, v in x:
                if v is not None:
                    num, den = v + d * num, 1 + d * den
                out.append(num / den if den else None)
            cols.append(out)
        wanted[s] = list(zip(*cols))
    same(found, wanted)


@pytest.mark.parametrize("n", [1, 2, 5, 16, 63])
def test_rolling_drawdown(spark, series, n):
    df = frame(spark, series)
    found = collected(blocks.in_blocks(df, n - 1, lambda d, w: blocks.with_rolling_drawdown(d, n, w=w), order="t0", rows=400), "rolling_max_drawdown")
    wanted = {}
    for s, x in series.items():
        values, out = [v for _, v in x], []
        for i in range(len(values)):
            f = values[i - n + 1 : i + 1] if i + 1 >= n else [None]
            out.append((None,) if None in f else (min(0.0, *[d for _, _, d in plain_path(f)]),))
        wanted[s] = out
    same(found, wanted)


@pytest.mark.parametrize("n,level", [(1, 0.05), (20, 0.05), (63, 0.5), (63, 0.01)])
def test_rolling_tails(spark, series, n, level):
    found = collected(ind.rolling_tails(frame(spark, series), n, level, order="t0", rows=400), "rolling_var", "rolling_es")
    wanted = {}
    for s, x in series.items():
        values, out = [v for _, v in x], []
        for i in range(len(values)):
            f = values[i - n + 1 : i + 1] if i + 1 >= n else [None]
            if None in f:
                out.append((None, None))
            else:
                q = float(np.quantile(f, level))
                out.append((q, float(np.mean([v for v in f if v <= q + 1e-15]))))
        wanted[s] = out
    same(found, wanted)


def test_wavelet_matrix_like_sorting():
    r = np.random.default_rng(4)
    for size in (1, 2, 9, 100, 257):
        values = np.round(r.normal(size=size), 1)
        tree = WaveletMatrix(values)
        lo = r.integers(0, size, 50)
        hi = lo + 1 + r.integers(0, size, 50) % (size - lo)
        k = r.integers(0, size, 50) % (hi - lo)
        limit = np.round(r.normal(size=50), 1)
        assert tree.kth(lo, hi, k).tolist() == [np.sort(values[a:b])[i] for a, b, i in zip(lo, hi, k)]
        count, total = tree.upto(lo, hi, limit)
        assert count.tolist() == [(values[a:b] <= x).sum() for a, b, x in zip(lo, hi, limit)]
        assert np.allclose(total, [values[a:b][values[a:b] <= x].sum() for a, b, x in zip(lo, hi, limit)])
    assert all(np.isnan(x).all() for x in rolling_tail(np.array([1.0, np.nan]), 2, 0.5))
