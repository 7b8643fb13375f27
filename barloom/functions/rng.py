"""A counter-based random generator in plain integer arithmetic, so that Spark and any SQL engine draw the same numbers.

A draw depends on (seed, a, b) alone: no state, no partition, no order of evaluation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

M = 2147483647


def draw(a: Column | str, b: Column | str, seed: int = 0) -> Column:
    """A long in [0, M)."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    x = ((a.cast("long") * 1000003 + b.cast("long") * 7919 + seed) % M) * 48271 % M
    for _ in range(2):
        x = (x * ((x % 46337) + 1) + F.floor(x / 65537)) % M
    return x.cast("long")


def uniform(a: Column | str, b: Column | str, seed: int = 0) -> Column:
    return draw(a, b, seed) / F.lit(float(M))


def normal(a: Column | str, b: Column | str, seed: int = 0) -> Column:
    """Box-Muller on two draws."""
    u, v = (draw(a, b, seed) + 1) / F.lit(float(M + 1)), uniform(a, b, seed + 104729)
    return F.sqrt(F.log(u) * -2.0) * F.cos(v * (2 * math.pi))


def draw_sql(a: str, b: str, seed: int = 0) -> str:
    x = f"((cast({a} as bigint) * 1000003 + cast({b} as bigint) * 7919 + {seed}) % {M}) * 48271 % {M}"
    for _ in range(2):
        x = f"list_transform([{x}], lambda x: (x * ((x % 46337) + 1) + x // 65537) % {M})[1]"
    return f"({x})"


def uniform_sql(a: str, b: str, seed: int = 0) -> str:
    return f"({draw_sql(a, b, seed)} / {M}.0::double)"


def normal_sql(a: str, b: str, seed: int = 0) -> str:
    u, v = f"(({draw_sql(a, b, seed)} + 1) / {M + 1}.0::double)", uniform_sql(a, b, seed + 104729)
    return f"(sqrt(ln({u}) * -2.0) * cos({v} * {2 * math.pi!r}))"
