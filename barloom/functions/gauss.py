"""Sums of Gaussian kernels over all pairs of two samples, in near-linear time."""

from __future__ import annotations

import math

import numpy as np

#: Width of a box over the kernel's length, terms of an expansion, and how far boxes are held against each other, in kernel lengths.
BOX, TERMS, REACH = 0.5, 22, 6.5


class Moments:
    """A sample in boxes of BOX kernel lengths: the scaled power sums of each occupied box about its centre."""

    def __init__(self, x: np.ndarray, length: float):
        self.n = len(x)
        place = np.asarray(x, float) / (length * BOX)
        box = np.floor(place)
        self.boxes, at = np.unique(box, return_inverse=True)
        u = (place - box - 0.5) * BOX
        term = np.ones(len(u))
        self.sums = np.empty((TERMS, len(self.boxes)))
        for k in range(TERMS):
            self.sums[k] = np.bincount(at, term, len(self.boxes))
            term = term * u / (k + 1)


def pair_sum(a: Moments, b: Moments) -> float:
    """The sum of exp(-((x - y) / length)^2) over all x of a and y of b, both with one kernel length.

    Between two boxes the kernel is expanded about the distance of their centres: with w the difference of the places within the boxes, |w| <= BOX,
    exp(-(d + w)^2) = sum of (-1)^n h_n(d) w^n / n!, h_n being the Hermite functions, and w^n is a product of both boxes' power sums. The terms left out are under
    BOX^n sqrt(2^n / n!) = 2e-14 a pair, and pairs further apart than REACH lengths are under exp(-36) each. Time: samples x TERMS + boxes x TERMS^2.
    """
    signs = (-1.0) ** np.arange(TERMS)
    total = 0.0
    steps = math.ceil(REACH / BOX)
    for step in range(-steps, steps + 1):
        at = np.searchsorted(b.boxes, a.boxes + step)
        met = at < len(b.boxes)
        met[met] = b.boxes[at[met]] == a.boxes[met] + step
        if not met.any():
            continue
        m, n = a.sums[:, met], b.sums[:, at[met]] * signs[:, None]
        d = -step * BOX
        before, h = 0.0, math.exp(-d * d)  # h_0; then h_n+1 = 2 d h_n - 2 n h_n-1
        for k in range(TERMS):
            total += (-1) ** k * h * float(np.einsum("ij,ij->", m[: k + 1], n[k::-1]))
            before, h = h, 2 * d * h - 2 * k * before
    return total


def median_squared_difference(x: np.ndarray) -> float:
    """The median of the squared differences of all pairs, without making them: differences up to a value are counted on the sorted sample, and the value is found by bisection."""
    x = np.sort(np.asarray(x, float))
    n = len(x)
    pairs = n * (n - 1) // 2
    if not pairs:
        return 0.0
    below = np.arange(n) + 1

    def upto(t: float) -> int:
        return int((np.searchsorted(x, x + t, side="right") - below).sum())

    def smallest(k: int) -> float:
        """The difference of rank k (from 1), to the last bit of a double."""
        lo, hi = -1, int(np.float64(x[-1] - x[0]).view(np.int64)) + 4  # doubles at or above 0 are in the order of their bits
        while hi - lo > 1:
            middle = (lo + hi) // 2
            lo, hi = (lo, middle) if upto(float(np.int64(middle).view(np.float64))) >= k else (middle, hi)
        return float(np.int64(hi).view(np.float64))

    return (smallest((pairs + 1) // 2) ** 2 + smallest(pairs // 2 + 1) ** 2) / 2
