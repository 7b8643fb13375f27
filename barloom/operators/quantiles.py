"""Exact quantiles of groups of any size, with bounded state.

`percentile` keeps every distinct value of a group in one buffer. Here a mergeable sketch brackets the ranks that are asked for, one count confirms the
bracket and sketches what is inside, and so on until few values are left; those alone are sorted. Each round narrows a bracket by a factor of about
eighty, so a billion values take three passes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import windows as win
from ..sources.shared import written

#: Values of a bracket that one task may sort.
LIMIT = 100_000
#: Steps of the sketch's grid, and the sketch's accuracy: ranks are right to 1 in so many.
GRID, ACCURACY = 256, 10_000
#: Brackets that are broadcast, of some 100 bytes each; past that they are joined by key.
BROADCAST_BRACKETS = 100_000


def _grid(v: Column) -> Column:
    return F.percentile_approx(v, F.array(*[F.lit(i / GRID) for i in range(GRID + 1)]), F.lit(ACCURACY))


def _narrowed(state: DataFrame) -> DataFrame:
    """_lo2 and _hi2: the steps of the grid around the ranks, two to spare. A step is far wider than the sketch's error."""
    share = lambda k: (F.col(k) - F.col("_below")) / F.greatest("_inside", F.lit(1))
    at = lambda i: F.element_at("_grid", (F.greatest(F.least(i, F.lit(GRID)), F.lit(0)) + 1).cast("int"))
    return state.withColumns({"_lo2": at(F.floor(share("_k1") * GRID) - 1), "_hi2": at(F.ceil(share("_k2") * GRID) + 1)})


def _bracketed(values: DataFrame, state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The values that lie in the brackets of their group, with the brackets' columns."""
    few = state.count() <= BROADCAST_BRACKETS
    return values.join(F.broadcast(state) if few else state, list(keys)).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))


def exact_quantiles(values: DataFrame, fractions: Sequence[float], value: str = "ret", keys: Sequence[str] = win.KEYS, limit: int = LIMIT) -> DataFrame:
    """(keys, fraction, n, quantile): linear between neighbours, over the values that are neither null nor NaN.

    A group of more than `limit` values is never sorted or held whole. Equal values count together, so a value that many rows have ends the search. Keys are not null.
    """
    v = values.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*keys, F.col(value).cast("double").alias("_v"))
    first = written(v.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), _grid(F.col("_v")).alias("_grid")), "sketches")
    state = first.withColumn("fraction", F.explode(F.array(*[F.lit(float(q)) for q in fractions])))
    place = (F.col("_n") - 1) * F.col("fraction")
    state = state.withColumns({"_k1": F.floor(place), "_k2": F.least(F.floor(place) + 1, F.col("_n") - 1), "_below": F.lit(0).cast("long"), "_inside": F.col("_n")})
    state = state.withColumn("_open", F.col("_n") > limit)
    held = [*keys, "fraction", "_n", "_k1", "_k2", "_lo", "_hi", "_below", "_inside"]
    closed = state.where("not _open").select(*held)
    left = written(state.where("_open").drop("_open"), "brackets")
    while not left.isEmpty():
        tried = _narrowed(left).drop("_grid")
        within = F.col("_v").between(F.col("_lo2"), F.col("_hi2"))
        found = _bracketed(v, tried, keys).groupBy(*held, "_lo2", "_hi2").agg(
            F.count_if(F.col("_v") < F.col("_lo2")).alias("_lower"), F.count_if(within).alias("_within"), _grid(F.when(within, F.col("_v"))).alias("_grid")
        )
        sound = (F.col("_below") + F.col("_lower") <= F.col("_k1")) & (F.col("_k2") < F.col("_below") + F.col("_lower") + F.col("_within"))
        moved = sound & (F.col("_within") < F.col("_inside"))
        next_ = found.withColumns({"_sound": sound, "_open": moved & (F.col("_within") > limit) & (F.col("_lo2") < F.col("_hi2"))})
        # A bracket that narrows no more holds few values, each many times; one that the count refutes is left as it was.
        to = {"_lo": F.when(F.col("_sound"), F.col("_lo2")).otherwise(F.col("_lo")), "_hi": F.when(F.col("_sound"), F.col("_hi2")).otherwise(F.col("_hi"))}
        to |= {"_below": F.when(F.col("_sound"), F.col("_below") + F.col("_lower")).otherwise(F.col("_below")), "_inside": F.when(F.col("_sound"), F.col("_within")).otherwise(F.col("_inside"))}
        next_ = written(next_.withColumns(to).select(*held, "_grid", "_open"), "brackets")
        closed = closed.unionByName(next_.where("not _open").select(*held))
        left = next_.where("_open").drop("_open")
    closed = written(closed, "brackets")
    counted = _bracketed(v, closed, keys).groupBy(*held, "_v").agg(F.count("*").alias("_c"))
    upto = F.col("_below") + F.sum("_c").over(Window.partitionBy(*keys, "fraction").orderBy("_v"))
    at = lambda k: F.min(F.when(F.col("_upto") > F.col(k), F.col("_v")))
    picked = counted.withColumn("_upto", upto).groupBy(*keys, "fraction", F.col("_n").alias("n")).agg(at("_k1").alias("_a"), at("_k2").alias("_b"))
    place = (F.col("n") - 1) * F.col("fraction")
    return picked.select(*keys, "fraction", "n", (F.col("_a") + (F.col("_b") - F.col("_a")) * (place - F.floor(place))).alias("quantile"))


def historical_tails(returns: DataFrame, levels: Sequence[float], value: str = "ret", keys: Sequence[str] = win.KEYS, limit: int = LIMIT) -> DataFrame:
    """(keys, level, var, cvar): the exact quantile at 1 - level, and the mean of the values at or under it."""
    cuts = written(exact_quantiles(returns, [1 - x for x in levels], value, keys, limit), "cuts")
    named = F.element_at(F.array(*[F.lit(float(x)) for x in levels]), F.array_position(F.array(*[F.lit(1 - x) for x in levels]), F.col("fraction")).cast("int"))
    cuts = cuts.select(*keys, named.alias("level"), F.col("quantile").alias("var"))
    few = cuts.count() <= BROADCAST_BRACKETS
    under = returns.select(*keys, F.col(value).cast("double").alias("_v")).join(F.broadcast(cuts) if few else cuts, list(keys)).where(F.col("_v") <= F.col("var"))
    return under.groupBy(*keys, "level", "var").agg(F.avg("_v").alias("cvar"))
