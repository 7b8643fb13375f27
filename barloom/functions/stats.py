"""Distribution functions and one-sample tests in NumPy."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np

_N = NormalDist()


def norm_cdf(x: np.ndarray | float) -> np.ndarray:
    return np.vectorize(_N.cdf, otypes=[float])(np.clip(x, -38, 38))


def chi2_sf(x: float, df: int) -> float:
    """Survival function for whole degrees of freedom, by the recurrence in steps of two."""
    if not x > 0:
        return 1.0
    h = x / 2
    if df % 2:
        out, term, k = math.erfc(math.sqrt(h)), math.exp(-h) * math.sqrt(h) / math.gamma(1.5), 1.5
    else:
        out, term, k = math.exp(-h), math.exp(-h) * h, 2.0
    steps = (df - 1) // 2 if df % 2 else df // 2 - 1
    for _ in range(steps):
        out += term
        term *= h / k
        k += 1
    return min(1.0, max(0.0, out))


def kolmogorov_sf(d: float, n: int) -> float:
    """Asymptotic, with the usual correction of the argument for small n."""
    if d <= 0:
        return 1.0
    z = d * (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n))
    if z < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * (k * z) ** 2) for k in range(1, 101))))


def _ks(u: np.ndarray) -> tuple[float, float]:
    n = len(u)
    k = np.arange(1, n + 1)
    d = float(max((k / n - u).max(), (u - (k - 1) / n).max()))
    return d, kolmogorov_sf(d, n)


def ks_normal(x: Sequence[float]) -> tuple[float, float]:
    """Against the normal distribution with the sample's own mean and deviation."""
    x = np.sort(np.asarray(x, float))
    if len(x) < 2 or x.std(ddof=1) == 0:
        return math.nan, math.nan
    return _ks(norm_cdf((x - x.mean()) / x.std(ddof=1)))


def ks_uniform(x: Sequence[float]) -> tuple[float, float]:
    """Against the uniform distribution over the sample's own range."""
    x = np.sort(np.asarray(x, float))
    if len(x) < 2 or x[0] == x[-1]:
        return math.nan, math.nan
    return _ks((x - x[0]) / (x[-1] - x[0]))


def anderson_darling(x: Sequence[float]) -> tuple[float, float]:
    """The statistic against a fitted normal, and its critical value at 5 %."""
    x = np.sort(np.asarray(x, float))
    n = len(x)
    if n < 8 or x.std(ddof=1) == 0:
        return math.nan, math.nan
    u = np.clip(norm_cdf((x - x.mean()) / x.std(ddof=1)), 1e-300, 1 - 1e-16)
    i = np.arange(1, n + 1)
    a2 = -n - float(((2 * i - 1) / n * (np.log(u) + np.log1p(-u[::-1]))).sum())
    return a2, 0.787 / (1 + 4 / n - 25 / n**2)


def ranks(x: np.ndarray) -> np.ndarray:
    """Ranks from 1, ties sharing their mean."""
    order = np.argsort(x, kind="stable")
    s = x[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    last = np.concatenate([first[1:], [len(s)]])
    out = np.empty(len(x))
    out[order] = np.repeat((first + 1 + last) / 2, last - first)
    return out


def wilcoxon(x: Sequence[float]) -> tuple[float, float]:
    """Signed ranks against a median of zero, by the normal approximation with correction for ties; from six non-zero values."""
    x = np.asarray(x, float)
    x = x[x != 0]
    n = len(x)
    if n < 6:
        return math.nan, math.nan
    r = ranks(np.abs(x))
    plus, minus = r[x > 0].sum(), r[x < 0].sum()
    t = min(plus, minus)
    _, c = np.unique(np.abs(x), return_counts=True)
    var = n * (n + 1) * (2 * n + 1) / 24 - (c**3 - c).sum() / 48
    return float(t), min(1.0, 2 * _N.cdf((t - n * (n + 1) / 4) / math.sqrt(var)))


def mann_whitney(x: Sequence[float], y: Sequence[float]) -> tuple[float, float]:
    x, y = np.asarray(x, float), np.asarray(y, float)
    n, m = len(x), len(y)
    if not n or not m:
        return math.nan, math.nan
    both = np.concatenate([x, y])
    u = ranks(both)[:n].sum() - n * (n + 1) / 2
    _, c = np.unique(both, return_counts=True)
    var = n * m / 12 * (n + m + 1 - (c**3 - c).sum() / max(1, (n + m) * (n + m - 1)))
    if var <= 0:
        return float(u), 1.0
    z = (abs(u - n * m / 2) - 0.5) / math.sqrt(var)
    return float(u), min(1.0, 2 * (1 - _N.cdf(max(0.0, z))))


def arch_lm(x: Sequence[float], lags: int = 5) -> tuple[float, float]:
    """n R^2 of squared deviations on their own lags, chi-squared with `lags` degrees of freedom."""
    x = np.asarray(x, float)
    e = (x - x.mean()) ** 2
    n = len(e) - lags
    if n <= lags + 1 or e.std() == 0:
        return math.nan, math.nan
    design = np.column_stack([np.ones(n), *[e[lags - k : len(e) - k] for k in range(1, lags + 1)]])
    y = e[lags:]
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    r2 = 1 - ((y - design @ beta) ** 2).sum() / max(1e-300, ((y - y.mean()) ** 2).sum())
    return float(n * r2), chi2_sf(n * r2, lags)


def shapiro(x: Sequence[float]) -> tuple[float, float]:
    """Royston's 1992 approximation for 12 to 5000 values (the p-value is that of larger samples too)."""
    x = np.sort(np.asarray(x, float))
    n = len(x)
    if n < 12 or x[0] == x[-1]:
        return math.nan, math.nan
    m = np.array([_N.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    c = m / math.sqrt((m**2).sum())
    u = 1 / math.sqrt(n)
    last = np.polyval([-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, c[-1]], u)
    next_ = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, c[-2]], u)
    phi = ((m**2).sum() - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * next_**2)
    a = m / math.sqrt(phi)
    a[-1], a[-2], a[0], a[1] = last, next_, -last, -next_
    w = min(1.0, float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum()))
    ln = math.log(n)
    mu = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], ln)
    sigma = math.exp(np.polyval([0.0030302, -0.082676, -0.4803], ln))
    return w, 1 - _N.cdf((math.log(max(1e-300, 1 - w)) - mu) / sigma)
