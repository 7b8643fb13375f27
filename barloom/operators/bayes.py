"""Bayesian search: a Gaussian process over the scaled box, batches chosen by expected improvement. Each batch is one Spark plan."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from statistics import NormalDist

import numpy as np


def _kernel(a: np.ndarray, b: np.ndarray, width: float) -> np.ndarray:
    return np.exp(-np.square(a[:, None, :] - b[None, :, :]).sum(axis=2) / (2 * width * width))


def posterior(x: np.ndarray, y: np.ndarray, at: np.ndarray, width: float = 0.25, noise: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    mean, scale = y.mean(), y.std() or 1.0
    k = _kernel(x, x, width) + noise * np.eye(len(x))
    cross = _kernel(at, x, width)
    solved = np.linalg.solve(k, np.column_stack([(y - mean) / scale, cross.T]))
    var = np.clip(1 - (cross * solved[:, 1:].T).sum(axis=1), 1e-12, None)
    return mean + scale * cross @ solved[:, 0], scale * np.sqrt(var)


def expected_improvement(mu: np.ndarray, sd: np.ndarray, best: float) -> np.ndarray:
    z = (mu - best) / sd
    normal = NormalDist()
    cdf = np.array([normal.cdf(v) for v in z])
    return (mu - best) * cdf + sd * np.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def search(evaluate: Callable[[list[np.ndarray]], list[float]], bounds: Sequence[tuple[float, float]], rounds: int = 5, batch: int = 4, seed: int = 0) -> list[tuple[np.ndarray, float]]:
    """(point, score) in the order of evaluation. The first batch is drawn, each later one maximises the improvement expected from it.

    Within a batch a chosen point counts as if it had scored its mean. Scores that are not finite count as the lowest seen.
    """
    rng = np.random.default_rng(seed)
    lo, hi = np.array(bounds, float).T
    x, y = np.empty((0, len(lo))), np.empty(0)
    for k in range(rounds):
        if k == 0:
            chosen = rng.random((batch, len(lo)))
        else:
            pool = rng.random((512, len(lo)))
            px, py, picks = x, y, []
            for _ in range(batch):
                mu, sd = posterior(px, py, pool)
                at = int(np.argmax(expected_improvement(mu, sd, py.max())))
                picks.append(pool[at])
                px, py = np.vstack([px, pool[at]]), np.append(py, mu[at])
            chosen = np.array(picks)
        scores = np.array(evaluate([lo + c * (hi - lo) for c in chosen]), float)
        finite = np.concatenate([y, scores[np.isfinite(scores)]])
        scores[~np.isfinite(scores)] = finite.min() if len(finite) else 0.0
        x, y = np.vstack([x, chosen]), np.append(y, scores)
    return [(lo + c * (hi - lo), float(s)) for c, s in zip(x, y)]
