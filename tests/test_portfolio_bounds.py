"""The Ward order against a plain version, and at the size that is allowed."""

from __future__ import annotations

import itertools
import math
import time

import numpy as np

from barloom.operators import portfolio as pf


def plain_order(points):
    groups = {i: [i] for i in range(len(points))}
    d = {(i, j): float(np.linalg.norm(points[i] - points[j])) for i, j in itertools.combinations(groups, 2)}
    while len(groups) > 1:
        i, j = min(d, key=lambda k: (d[k], k))
        ni, nj, c = len(groups[i]), len(groups[j]), d[i, j]
        for k in groups:
            if k not in (i, j):
                nk, (a, b) = len(groups[k]), (d[min(x, k), max(x, k)] for x in (i, j))
                d[min(i, k), max(i, k)] = math.sqrt(((ni + nk) * a * a + (nj + nk) * b * b - nk * c * c) / (ni + nj + nk))
        groups[i] += groups.pop(j)
        d = {k: v for k, v in d.items() if j not in k}
    return next(iter(groups.values()))


def test_ward_order():
    r = np.random.default_rng(3)
    for n in (1, 2, 3, 17, 40):
        points = r.normal(size=(n, 5))
        assert pf.ward_order(points) == plain_order(points)


def test_hierarchical_weights_of_many_assets():
    r = np.random.default_rng(4)
    x = r.normal(size=(900, 600)) + r.normal(size=(900, 1))
    began = time.process_time()
    w = pf.hierarchical_risk_parity(np.cov(x, rowvar=False))
    assert time.process_time() - began < 60
    assert math.isclose(w.sum(), 1) and (w > 0).all()
