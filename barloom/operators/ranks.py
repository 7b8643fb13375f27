"""Ranks over all tasks, and the tests that are sums over them.

Equal values are counted together and dealt by ranges of values; the ranks of a range begin where the counts of the ranges before it end. No task holds a series.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import stats
from ..sources.shared import written


def global_ranks(values: DataFrame, value: str, keys: Sequence[str], sums: dict[str, Column] | None = None) -> DataFrame:
    """(keys, value, n, below, and each of `sums` with its <name>_below): how many rows of a group have each value, and how many a smaller one.

    sums: further aggregates that add up, such as the count of one of two samples. Nulls have no rank. Ties share a row; their mean rank is below + (n + 1) / 2.
    """
    sums = {"n": F.count("*")} | (sums or {})
    counts = values.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(*[c.alias(name) for name, c in sums.items()])
    dealt = written(counts.repartitionByRange(*keys, value).withColumn("_range", F.spark_partition_id()), "ranks")
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = dealt.groupBy(*keys, "_range").agg(*[F.sum(name).alias(name) for name in sums])
    w = Window.partitionBy(*keys).orderBy("_range")
    starts = ranges.select(*keys, "_range", *[before(name, w).alias(f"_from_{name}") for name in sums])
    w = Window.partitionBy(*keys, "_range").orderBy(value)
    local = dealt.withColumns({f"_in_{name}": before(name, w) for name in sums})
    below = lambda name: "below" if name == "n" else f"{name}_below"
    out = local.join(starts, [*keys, "_range"])
    return out.select(*keys, value, *sums, *[(F.col(f"_from_{name}") + F.col(f"_in_{name}")).alias(below(name)) for name in sums])


def _udf(f):
    """A scalar function of one or two columns, applied to batches."""

    def one(a: pd.Series) -> pd.Series:
        return a.map(f).astype(float)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(x, y) for x, y in zip(a, b)], dtype=float)

    return F.pandas_udf(one if f.__code__.co_argcount == 1 else two, "double")


def _phi(x: float) -> float:
    return math.erfc(-x / math.sqrt(2)) / 2 if x == x else math.nan


def _two_sided(z: float) -> float:
    return min(1.0, math.erfc(max(0.0, z) / math.sqrt(2))) if z == z else math.nan


def _below_z(z: float) -> float:
    return min(1.0, 2 * _phi(z)) if z == z else math.nan


def _kolmogorov(d: float, n: float) -> float:
    return stats.kolmogorov_sf(d, int(n)) if d == d else math.nan


def rank_tests(series: DataFrame, value: str = "ret", key: str = "series") -> DataFrame:
    """(key, test, statistic, p_value) of ks_normal, ks_uniform, anderson_darling, wilcoxon and mann_whitney_zero, as sums over global ranks.

    Anderson-Darling has its critical value at 5 % in place of a p-value. Too few values, or all alike, give null.
    """
    x = series.where(F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias("x"))
    whole = x.groupBy(key).agg(F.count("*").alias("size"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.min("x").alias("least"), F.max("x").alias("most"))
    whole = written(whole, "moments")
    at = global_ranks(x, "x", [key]).join(whole, key)
    z = (F.col("x") - F.col("mean")) / F.nullif("sd", F.lit(0.0))
    at = at.withColumn("_u", _udf(_phi)(z))
    n, below, upto = F.col("n").cast("double"), F.col("below").cast("double"), (F.col("below") + F.col("n")).cast("double")

    def distance(u: Column) -> Column:
        return F.greatest(F.max(upto / F.col("size") - u), F.max(u - below / F.col("size")))

    u = F.least(F.greatest(F.col("_u"), F.lit(1e-300)), F.lit(1 - 1e-16))
    # i runs over the ranks of a tie: sums of 2 i - 1 and of 2 N + 1 - 2 i.
    odd = upto * upto - below * below
    anderson = -F.max("size") - F.sum(odd * F.log(u) + (n * 2 * F.col("size") - odd) * F.log1p(-u)) / F.max("size")
    zero = F.when(F.col("x") == 0, n).otherwise(0.0)
    tied = n + F.when(F.col("x") == 0, 1.0).otherwise(0.0)
    sums = at.groupBy(key, "size", "sd", "least", "most").agg(
        distance(F.col("_u")).alias("ks_normal"), distance((F.col("x") - F.col("least")) / F.nullif(F.col("most") - F.col("least"), F.lit(0.0))).alias("ks_uniform"), anderson.alias("anderson_darling"),
        (F.sum(F.when(F.col("x") > 0, n).otherwise(0.0)) + F.sum(zero) / 2).alias("u"), F.sum(tied * tied * tied - tied).alias("ties"),
    )
    signed = x.where("x <> 0").select(key, F.abs("x").alias("a"), (F.col("x") > 0).cast("long").alias("up"))
    places = global_ranks(signed, "a", [key], {"ups": F.sum("up")})
    middle = F.col("below") + (F.col("n") + 1) / 2
    c = F.col("n").cast("double")
    wilcoxon = places.groupBy(key).agg(F.sum(middle * F.col("ups")).alias("plus"), F.sum(middle * (F.col("n") - F.col("ups"))).alias("minus"), F.sum("n").cast("double").alias("m"), F.sum(c * c * c - c).alias("even"))
    all_ = sums.join(wilcoxon, key, "left")

    N = F.col("size").cast("double")
    enough = lambda ok, c: F.when(ok, c)
    varied, spread = (F.col("size") >= 2) & (F.col("sd") > 0), F.col("most") > F.col("least")
    t, m = F.least("plus", "minus"), F.col("m")
    w_var = m * (m + 1) * (m * 2 + 1) / 24 - F.col("even") / 48
    u_var = N / 12 * (N + 2 - F.col("ties") / F.greatest((N + 1) * N, F.lit(1.0)))
    u_z = F.when(u_var > 0, (F.abs(F.col("u") - N / 2) - 0.5) / F.sqrt(F.greatest(u_var, F.lit(1e-300)))).otherwise(0.0)
    rows = {
        "ks_normal": (enough(varied, F.col("ks_normal")), lambda s: _udf(_kolmogorov)(s, N)),
        "ks_uniform": (enough(spread & (F.col("size") >= 2), F.col("ks_uniform")), lambda s: _udf(_kolmogorov)(s, N)),
        "anderson_darling": (enough(varied & (F.col("size") >= 8), F.col("anderson_darling")), lambda s: enough(varied & (F.col("size") >= 8), F.lit(0.787) / (F.lit(1.0) + F.lit(4.0) / N - F.lit(25.0) / (N * N)))),
        "wilcoxon": (enough(m >= 6, t), lambda s: _udf(_below_z)(enough(m >= 6, (t - m * (m + 1) / 4) / F.sqrt(w_var)))),
        "mann_whitney_zero": (F.col("u"), lambda s: _udf(_two_sided)(u_z)),
    }
    out = None
    for name, (statistic, p) in rows.items():
        one = all_.select(key, F.lit(name).alias("test"), statistic.alias("statistic"), p(statistic).alias("p_value"))
        out = one if out is None else out.unionByName(one)
    return out


def ks_two_sample(values: DataFrame, group: str, a: str, b: str, value: str = "ret", keys: Sequence[str] = ("series",)) -> DataFrame:
    """(keys, statistic): the largest difference of two groups' distribution functions."""
    both = values.where(F.col(group).isin(a, b) & F.col(value).isNotNull())
    first = {"a": F.count_if(F.col(group) == a)}
    total = both.groupBy(*keys).agg(first["a"].alias("_na"), F.count("*").alias("_n"))
    at = global_ranks(both, value, keys, first).join(total, list(keys))
    fa = (F.col("a_below") + F.col("a")) / F.nullif("_na", F.lit(0))
    fb = (F.col("below") + F.col("n") - F.col("a_below") - F.col("a")) / F.nullif(F.col("_n") - F.col("_na"), F.lit(0))
    return at.groupBy(*keys).agg(F.max(F.abs(fa - fb)).alias("statistic"))


def mann_whitney_two_sample(values: DataFrame, group: str, a: str, b: str, value: str = "ret", keys: Sequence[str] = ("series",)) -> DataFrame:
    """(keys, statistic, p_value): U of group a against b by mean ranks over the union; two-sided by the normal law, corrected for ties and continuity."""
    both = values.where(F.col(group).isin(a, b) & F.col(value).isNotNull())
    at = global_ranks(both, value, keys, {"a": F.count_if(F.col(group) == a)})
    c = F.col("n").cast("double")
    s = at.groupBy(*keys).agg(F.sum((F.col("below") + (F.col("n") + 1) / 2) * F.col("a")).alias("_s"), F.sum("a").cast("double").alias("_n"), F.sum(c).alias("_all"), F.sum(c * c * c - c).alias("_ties"))
    s = s.withColumn("_m", F.col("_all") - F.col("_n")).where("_n > 0 and _m > 0")
    nm = F.col("_n") * F.col("_m")
    var = nm / 12 * (F.col("_all") + 1 - F.col("_ties") / (F.col("_all") * (F.col("_all") - 1)))
    u = F.col("_s") - F.col("_n") * (F.col("_n") + 1) / 2
    z = F.when(var > 0, (F.abs(u - nm / 2) - 0.5) / F.sqrt(F.greatest(var, F.lit(1e-300)))).otherwise(0.0)
    return s.select(*keys, u.alias("statistic"), _udf(_two_sided)(z).alias("p_value"))
