"""Resampling of return series. Every draw comes from the counter generator, so a run can be repeated anywhere.

Series are (series, t, ret) with t = 0 .. n-1. Samples are (series, sim, t, ret). A sample is a projection of
(sim, t) to an index and one join by index; the simulations are dealt over the cluster and never meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rng
from ..functions.gauss import Moments, median_squared_difference, pair_sum
from ..sources.shared import written

METHODS = ("iid", "block", "circular", "stationary", "wild")


def series_of(returns: DataFrame, key: str = "symbol") -> DataFrame:
    """(series, t, ret) from rows with a return, renumbered from 0."""
    r = returns.where(F.col("ret").isNotNull())
    return r.select(F.col(key).alias("series"), (F.row_number().over(Window.partitionBy(key).orderBy("ts")) - 1).cast("long").alias("t"), "ret")


def resample(series: DataFrame, n_sims: int, method: str = "iid", block: int = 20, seed: int = 0) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}")
    size = series.groupBy("series").agg(F.count("*").alias("n"), F.avg("ret").alias("mu"))
    sims = size.crossJoin(F.broadcast(series.sparkSession.range(n_sims).withColumnRenamed("id", "sim")))  # a row for each path
    grid = sims.withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    t, n, sim = F.col("t"), F.col("n"), F.col("sim")
    length = F.least(F.lit(block).cast("long"), n)
    b = F.floor(t / length)
    if method == "iid":
        index: Column = rng.draw(sim, t, seed) % n
    elif method == "block":
        index = rng.draw(sim, b, seed) % (n - length + 1) + t % length
    elif method == "circular":
        index = (rng.draw(sim, b, seed) % n + t % length) % n
    elif method == "stationary":
        grid = grid.withColumn("_at", F.when((t == 0) | (rng.uniform(sim, t, seed + 15485863) < F.lit(1.0) / length), t))
        grid = grid.withColumn("_at", F.last("_at", ignorenulls=True).over(Window.partitionBy("series", "sim").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)))
        index = (rng.draw(sim, F.col("_at"), seed) % n + t - F.col("_at")) % n
    else:
        index = t
    picked = grid.withColumn("_index", index).join(series.select("series", F.col("t").alias("_index"), "ret"), ["series", "_index"])
    value = F.col("ret")
    if method == "wild":
        value = F.col("mu") + (F.col("ret") - F.col("mu")) * (rng.draw(sim, t, seed) % 2 * 2 - 1)
    return picked.select("series", "sim", "t", value.alias("ret"))


def shared(df: DataFrame, name: str) -> DataFrame:
    """A table that an analysis reads several times, written once to the shared folder."""
    return written(df, name)


def permute(series: DataFrame, n_sims: int, block: int = 1, seed: int = 0) -> DataFrame:
    """Samples without replacement: the series in a drawn order, of single values or of whole blocks that do not overlap."""
    sims = series.sparkSession.range(n_sims).withColumnRenamed("id", "sim")
    rows = series.crossJoin(F.broadcast(sims)).withColumn("_b", F.floor(F.col("t") / block))
    order = F.row_number().over(Window.partitionBy("series", "sim").orderBy(rng.draw("sim", "_b", seed), "_b", "t"))
    return rows.select("series", "sim", (order - 1).cast("long").alias("t"), "ret")


def wasserstein(series: DataFrame, samples: DataFrame) -> DataFrame:
    """(series, sim, distance) between the series and samples of its size: the mean difference of values of one rank."""
    a = series.select("series", F.row_number().over(Window.partitionBy("series").orderBy("ret", "t")).alias("k"), F.col("ret").alias("x"))
    b = samples.select("series", "sim", F.row_number().over(Window.partitionBy("series", "sim").orderBy("ret", "t")).alias("k"), F.col("ret").alias("y"))
    return b.join(a, ["series", "k"]).groupBy("series", "sim").agg(F.avg(F.abs(F.col("x") - F.col("y"))).alias("distance"))


class _Kernel:
    """The part of the kernel distance that a series has with itself: the kernel's width, and the sum over its pairs."""

    def __init__(self, x: np.ndarray):
        n = len(x)
        s2 = median_squared_difference(x) / (2 * np.log(n)) if n > 1 else 1.0
        self.length = float(np.sqrt(2 * s2)) if s2 > 1e-9 else np.sqrt(2.0)
        self.moments = Moments(x, self.length)
        self.own = pair_sum(self.moments, self.moments)

    def distance(self, y: np.ndarray) -> float:
        n, k = self.moments.n, len(y)
        if n < 2 or k < 2:
            return 0.0
        other = Moments(y, self.length)
        value = (self.own - n) / (n * (n - 1)) + (pair_sum(other, other) - k) / (k * (k - 1)) - 2 * pair_sum(self.moments, other) / (n * k)
        return float(np.sqrt(max(0.0, value)))


#: Values of all series together that are broadcast, of 8 bytes each; past that they are joined to their paths.
BROADCAST_VALUES = 4_000_000


def mmd(series: DataFrame, samples: DataFrame) -> DataFrame:
    """(series, sim, mmd) with a Gaussian kernel whose width comes from the series: by fast Gauss transforms, in time proportional to a path's length.

    Paths are dealt over the cluster; a task holds a path and its series, and what a series has with itself is found once a task. Nothing is collected.
    """
    originals = series.where("ret is not null").groupBy("series").agg(F.collect_list("ret").alias("x"))
    paths = samples.groupBy("series", "sim").agg(F.collect_list("ret").alias("y"))
    few = series.count() <= BROADCAST_VALUES

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, kernel = None, None
        for f in frames:
            out = []
            for own, x, y in zip(f["series"], f["x"], f["y"]):
                if kernel is None or own != name:
                    name, kernel = own, kernels.get(own) or kernels.setdefault(own, _Kernel(np.asarray(x)))
                out.append(kernel.distance(np.asarray(y)))
            yield pd.DataFrame({"series": f["series"], "sim": f["sim"], "mmd": out})

    kernels: dict[str, _Kernel] = {}
    return paths.join(F.broadcast(originals) if few else originals, "series").mapInPandas(run, "series string, sim long, mmd double")


#: Flips of a row, by the draw that they come from.
FLIPS = (22, 21, 21)


def _heads(sim: Column, word: Column, left: Column, seed: int) -> Column:
    """The heads of one row of 64 flips, or of the `left` that are still wanted: set bits of three draws."""
    out, before = F.lit(0), 0
    for k, bits in enumerate(FLIPS):
        wanted = F.least(F.greatest(left - before, F.lit(0)), F.lit(bits)).cast("int")
        out = out + F.bit_count(rng.draw(sim, word, seed + k * 15485863) % F.pow(F.lit(2.0), wanted).cast("long"))
        before += bits
    return out


def flips_sql(sim: str, word: str, left: str, seed: int = 0) -> str:
    parts, before = [], 0
    for k, bits in enumerate(FLIPS):
        parts.append(f"bit_count({rng.draw_sql(sim, word, seed + k * 15485863)} % (1::bigint << least(greatest({left} - {before}, 0), {bits})::int))")
        before += bits
    return f"({' + '.join(parts)})"


def sign_permutation(series: DataFrame, n_sims: int, seed: int = 0) -> DataFrame:
    """Whether positive returns are more, or fewer, than fair coins would give: observed count and p-values with the +1 correction. A row is 64 flips."""
    signs = series.where("ret <> 0")
    observed = signs.groupBy("series").agg(F.count_if(F.col("ret") > 0).alias("positive"), F.count("*").alias("m"))
    flips = observed.crossJoin(F.broadcast(series.sparkSession.range(n_sims).withColumnRenamed("id", "sim")))
    size = sum(FLIPS)
    flips = flips.withColumn("w", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / size))))
    heads = flips.groupBy("series", "sim", "positive", "m").agg(F.sum(_heads(F.col("sim"), F.col("w"), F.col("m") - F.col("w") * size, seed)).alias("heads"))
    p = lambda c: (F.count_if(c) + 1) / (F.count("*") + 1)
    h, x, m = F.col("heads"), F.col("positive"), F.col("m")
    return heads.groupBy("series", "positive", "m").agg(p(h >= x).alias("p_greater"), p(h <= x).alias("p_less"), p(F.abs(h - m / 2) >= F.abs(x - m / 2)).alias("p_two_sided"))


def mean_difference_permutation(series: DataFrame, a: str, b: str, n_sims: int, seed: int = 0) -> DataFrame:
    """p-value of the difference of two series' means when labels are dealt anew; without the +1 correction."""
    both = series.where(F.col("series").isin(a, b)).withColumn("k", F.col("t") * 2 + (F.col("series") == b).cast("long"))
    size = both.agg(F.count_if(F.col("series") == a).alias("n"), (F.avg(F.when(F.col("series") == a, F.col("ret"))) - F.avg(F.when(F.col("series") == b, F.col("ret")))).alias("observed"))
    drawn = both.crossJoin(F.broadcast(series.sparkSession.range(n_sims).withColumnRenamed("id", "sim"))).withColumn("rank", F.row_number().over(Window.partitionBy("sim").orderBy(rng.draw("sim", "k", seed), "k")))
    drawn = drawn.crossJoin(F.broadcast(size))
    first = F.col("rank") <= F.col("n")
    d = drawn.groupBy("sim", "observed").agg((F.avg(F.when(first, F.col("ret"))) - F.avg(F.when(~first, F.col("ret")))).alias("d"))
    return d.groupBy("observed").agg(F.avg((F.abs("d") >= F.abs("observed")).cast("double")).alias("p_value"), F.count("*").alias("n_sims"))


def intervals(stats: DataFrame, metrics: list[str], level: float = 0.95, keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """(keys, metric, mean, lo, hi, p_positive) of simulated metrics."""
    long = stats.unpivot(list(keys), metrics, "metric", "value").where("value is not null")
    lo = (1 - level) / 2
    out = long.groupBy(*keys, "metric").agg(F.avg("value").alias("mean"), F.percentile("value", F.array(F.lit(lo), F.lit(1 - lo))).alias("q"), F.avg((F.col("value") > 0).cast("double")).alias("p_positive"))
    return out.select(*keys, "metric", "mean", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"), "p_positive")
