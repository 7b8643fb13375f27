"""Tree surrogates for a search over a finite set of candidates: a random forest, and bagged boosted trees, both with a spread.

The models see the scored points alone, a few hundred at most; every batch of candidates that they choose is scored by one Spark plan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from .bayes import expected_improvement, posterior


@dataclass
class Node:
    value: float
    feature: int = -1
    cut: float = 0.0
    left: Node | None = None
    right: Node | None = None

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.left is None or self.right is None:
            return np.full(len(x), self.value)
        go = x[:, self.feature] <= self.cut
        out = np.empty(len(x))
        out[go], out[~go] = self.left.predict(x[go]), self.right.predict(x[~go])
        return out


def fit_tree(x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator | None = None, least: int = 1) -> Node:
    """A regression tree by squared error. With a generator the cuts of each split are drawn between neighbouring values, and a feature may be left out."""
    node = Node(float(y.mean()))
    if depth == 0 or len(y) < 2 * least or np.ptp(y) == 0:
        return node
    best = np.square(y - y.mean()).sum() * (1 - 1e-12)
    features = range(x.shape[1]) if rng is None else rng.permutation(x.shape[1])[: max(1, x.shape[1] - int(rng.random() < 0.3))]
    for f in features:
        values = np.unique(x[:, f])
        share = 0.5 if rng is None else rng.random(len(values) - 1)
        for cut in values[:-1] + (values[1:] - values[:-1]) * share:
            go = x[:, f] <= cut
            if least <= go.sum() <= len(y) - least:
                error = np.square(y[go] - y[go].mean()).sum() + np.square(y[~go] - y[~go].mean()).sum()
                if error < best:
                    best, node.feature, node.cut = error, int(f), float(cut)
    if node.feature >= 0:
        go = x[:, node.feature] <= node.cut
        node.left, node.right = fit_tree(x[go], y[go], depth - 1, rng, least), fit_tree(x[~go], y[~go], depth - 1, rng, least)
    return node


def _spread(parts: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and spread of the members of an ensemble; a floor keeps what all agree on worth a look."""
    return parts.mean(axis=0), np.maximum(parts.std(axis=0), 0.02 * (y.std() or 1.0))


def forest(x: np.ndarray, y: np.ndarray, at: np.ndarray, rng: np.random.Generator, trees: int = 40, depth: int = 8) -> tuple[np.ndarray, np.ndarray]:
    parts = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        parts.append(fit_tree(x[rows], y[rows], depth, rng).predict(at))
    return _spread(np.array(parts), y)


def boosted(x: np.ndarray, y: np.ndarray, at: np.ndarray, rng: np.random.Generator, bags: int = 8, trees: int = 25, depth: int = 2, rate: float = 0.3) -> tuple[np.ndarray, np.ndarray]:
    parts = []
    for _ in range(bags):
        rows = rng.integers(0, len(y), len(y))
        bx, by = x[rows], y[rows]
        fitted, found = np.full(len(by), by.mean()), np.full(len(at), by.mean())
        for _ in range(trees):
            tree = fit_tree(bx, by - fitted, depth)
            fitted, found = fitted + rate * tree.predict(bx), found + rate * tree.predict(at)
        parts.append(found)
    return _spread(np.array(parts), y)


def gaussian(x: np.ndarray, y: np.ndarray, at: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    return posterior(x, y, at)


SURROGATES: dict[str, Callable[..., tuple[np.ndarray, np.ndarray]]] = {"gaussian": gaussian, "forest": forest, "boosted": boosted}


def search(evaluate: Callable[[list[int]], list[float]], candidates: np.ndarray, surrogate: str, rounds: int = 6, batch: int = 6, seed: int = 0) -> list[tuple[int, float]]:
    """(candidate's row, score) in the order of evaluation; none is scored twice. The first batch is drawn, each later one has the most expected improvement.

    Scores that are not finite count as the lowest seen. Within a batch a chosen point counts as if it had scored its mean.
    """
    rng = np.random.default_rng(seed)
    lo, hi = candidates.min(axis=0), candidates.max(axis=0)
    scaled = (candidates - lo) / np.where(hi > lo, hi - lo, 1.0)
    done: list[int] = []
    scores = np.empty(0)
    for k in range(rounds):
        open_ = np.setdiff1d(np.arange(len(candidates)), done)
        if not len(open_):
            break
        if k == 0:
            chosen = rng.permutation(open_)[:batch].tolist()
        else:
            x, y, chosen = scaled[done], scores, []
            for _ in range(min(batch, len(open_))):
                mu, sd = SURROGATES[surrogate](x, y, scaled[open_], rng)
                at = int(np.argmax(expected_improvement(mu, sd, y.max())))
                chosen.append(int(open_[at]))
                x, y, open_ = np.vstack([x, scaled[open_[at]]]), np.append(y, mu[at]), np.delete(open_, at)
        found = np.array(evaluate(chosen), float)
        finite = np.concatenate([scores, found[np.isfinite(found)]])
        found[~np.isfinite(found)] = finite.min() if len(finite) else 0.0
        done += chosen
        scores = np.append(scores, found)
    return list(zip(done, scores.tolist()))
