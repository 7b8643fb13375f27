"""Tree surrogates on a known surface."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from barloom.operators import surrogates as su

GRID = np.array(list(itertools.product(range(12), range(10))), float)


def surface(p):
    """A single peak at (8, 3), with a step and a ridge on the way."""
    x, y = p
    return -((x - 8) ** 2) / 10 - abs(y - 3) + (x > 4) * 2.0 + (0.5 if x == y else 0.0)


BEST = int(np.argmax([surface(p) for p in GRID]))


@pytest.mark.parametrize("name", su.SURROGATES)
@pytest.mark.parametrize("seed", [0, 1])
def test_finds_the_best_within_its_budget(name, seed):
    calls = []

    def evaluate(chosen):
        calls.append(list(chosen))
        return [surface(GRID[k]) for k in chosen]

    history = su.search(evaluate, GRID, name, rounds=8, batch=5, seed=seed)
    assert [k for k, _ in history] == sum(calls, []) and len({k for k, _ in history}) == len(history) == 40  # of 120
    assert max(history, key=lambda x: x[1])[0] == BEST
    assert history == su.search(lambda c: [surface(GRID[k]) for k in c], GRID, name, rounds=8, batch=5, seed=seed)


@pytest.mark.parametrize("name", su.SURROGATES)
def test_scores_that_are_not_finite_and_small_grids(name):
    history = su.search(lambda c: [float("nan") if k % 2 else float(k) for k in c], np.array([[0.0], [1.0], [2.0], [3.0]]), name, rounds=9, batch=3)
    assert sorted(k for k, _ in history) == [0, 1, 2, 3] and max(history, key=lambda x: x[1]) == (2, 2.0)
    assert su.search(lambda c: [1.0 for _ in c], np.zeros((1, 2)), name, rounds=2, batch=2) == [(0, 1.0)]


def test_a_deep_tree_holds_its_points():
    r = np.random.default_rng(0)
    x, y = r.random((60, 3)), r.random(60)
    assert np.allclose(su.fit_tree(x, y, 60).predict(x), y)
    mu, sd = su.forest(x, y, x, r)
    assert np.corrcoef(mu, y)[0, 1] > 0.8 and (sd > 0).all()
