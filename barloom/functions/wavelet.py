"""Order statistics of many ranges of one array at once."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Ranks of an array, bit by bit from the highest, with counts and sums of the zeros so far.

    It answers for any number of ranges [lo, hi) at once, in one vector step for each bit: the k-th smallest value, and how many of the
    smallest there are and what they sum to. The cost of a range is the logarithm of the array's length, whatever the range's length. NaN is
    greater than all numbers, and 0 in sums.
    """

    def __init__(self, values: np.ndarray):
        order = np.argsort(values, kind="stable")
        self.sorted = values[order]
        rank = np.empty(len(values), np.int64)
        rank[order] = np.arange(len(values))
        self.bits = max(1, int(len(values)).bit_length())
        self.zeros, self.sums, self.split = [], [], []
        held = np.nan_to_num(values.astype(np.float64), nan=0.0, posinf=np.inf, neginf=-np.inf)
        for bit in reversed(range(self.bits)):
            zero = (rank >> bit & 1) == 0
            self.zeros.append(np.concatenate([[0], np.cumsum(zero)]))
            self.sums.append(np.concatenate([[0.0], np.cumsum(np.where(zero, held, 0.0))]))
            self.split.append(int(zero.sum()))
            rank, held = np.concatenate([rank[zero], rank[~zero]]), np.concatenate([held[zero], held[~zero]])

    def kth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value (from 0) of each range, which has more than k."""
        lo, hi, k, rank = lo.copy(), hi.copy(), k.copy(), np.zeros(len(lo), np.int64)
        for i, bit in enumerate(reversed(range(self.bits))):
            a, b = self.zeros[i][lo], self.zeros[i][hi]
            one = k >= b - a
            k -= np.where(one, b - a, 0)
            rank |= one.astype(np.int64) << bit
            lo, hi = np.where(one, self.split[i] + lo - a, a), np.where(one, self.split[i] + hi - b, b)
        return self.sorted[rank]

    def upto(self, lo: np.ndarray, hi: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each range: how many values are at most its limit, and their sum."""
        below = np.searchsorted(self.sorted, limit, side="right")  # ranks under this one
        lo, hi = lo.copy(), hi.copy()
        count, total = np.zeros(len(lo), np.int64), np.zeros(len(lo))
        for i, bit in enumerate(reversed(range(self.bits))):
            a, b = self.zeros[i][lo], self.zeros[i][hi]
            one = (below >> bit & 1) == 1
            count += np.where(one, b - a, 0)
            total += np.where(one, self.sums[i][hi] - self.sums[i][lo], 0.0)
            lo, hi = np.where(one, self.split[i] + lo - a, a), np.where(one, self.split[i] + hi - b, b)
        return count, total


def rolling_tail(values: np.ndarray, n: int, level: float) -> tuple[np.ndarray, np.ndarray]:
    """The quantile (linear between values) of every frame of the last n values, and the mean of the frame's values at or under it.

    NaN stands for no value; frames that are not full are NaN.
    """
    size = len(values)
    quantile, shortfall = np.full(size, np.nan), np.full(size, np.nan)
    known = ~np.isnan(values)
    seen = np.concatenate([[0], np.cumsum(known)])
    ends = np.arange(n, size + 1)
    ends = ends[seen[ends] - seen[ends - n] == n]
    if not len(ends):
        return quantile, shortfall
    tree = WaveletMatrix(values)
    place = (n - 1) * level
    low = np.full(len(ends), int(np.floor(place)))
    a = tree.kth(ends - n, ends, low)
    b = tree.kth(ends - n, ends, np.minimum(low + 1, n - 1))
    q = a + (b - a) * (place - np.floor(place))
    count, total = tree.upto(ends - n, ends, q)
    quantile[ends - 1], shortfall[ends - 1] = q, total / np.maximum(count, 1)
    return quantile, shortfall
