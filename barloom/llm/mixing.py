"""Mixing sources to target weights by capped water-filling.

Every source has a weight and may be repeated at most `max_epochs` times. Targets are min(cap, weight x
level) at the one level where they add up to the budget: the fixed point of clamping sources at
their caps and sharing the excess among the others by weight. It is found in one pass over the sources
sorted by cap / weight, the order in which they reach their caps as the level rises.

A source's documents are then taken whole: each floor(target / size) times, and once more as long as a
seeded order of them has not used up the rest. Long documents settle that first and the short ones take up
what is left, so that the miss is half a short document at most where there are enough of those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Copies, Scratch, bucket_offsets, stratum
from .sharding import SAME, same_rows

#: A document of more than this part of its source counts as long.
LONG = 1000


def n_words(text_col: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, max_epochs: int = 3) -> DataFrame:
    """sources(_stratum, weight, source_size) with target double. One row per source; all sources share 100 % of all sizes.

    A source without a weight above 0 has target 0. Where all others are at their caps, what is left of the budget is not taken.
    Windows over all sources run in one task, so sources are groups of documents, some thousands of them, and not, say, hosts.
    """
    weight = F.col("weight") > 0
    capped = sources.withColumn("_cap", F.col("source_size") * max_epochs).withColumn("_ratio", F.when(weight, F.col("_cap") / F.when(weight, F.col("weight")).otherwise(1.0)))
    every = Window.partitionBy()
    rising = Window.orderBy(F.asc_nulls_last("_ratio"), "_stratum")
    filled = (
        capped.withColumn("_total", F.sum("source_size").over(every))
        .withColumn("_full", F.coalesce(F.sum("_cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_open", F.sum(F.when(weight, F.col("weight"))).over(rising.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_level", F.when(weight, (F.col("_total") - F.col("_full")) / F.col("_open")))
    )
    level = F.min(F.when(F.col("_ratio") >= F.col("_level"), F.struct("_ratio", "_stratum", "_level"))).over(every)["_level"]
    filled = filled.withColumn("_at", level)
    full = F.col("_at").isNull() | (F.col("_ratio") <= F.col("_at"))
    target = F.when(~weight, F.lit(0.0)).when(full, F.col("_cap").cast("double")).otherwise(F.col("weight") * F.col("_at"))
    return filled.select("_stratum", "weight", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def mix_counts(
    docs: DataFrame,
    weights: DataFrame | None = None,
    max_epochs: int = 3,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    few: int | None = None,
) -> DataFrame:
    """How often each document is taken: id, _stratum, _key, size, source_size, target, times, taken.

    weights(source, weight double) defaults to 1, 2, 3, 1, ... by code point of the source, null last. A source
    that weights lacks, or names with null or nothing above 0, has target 0 and is not taken; weights of a source that is named twice are added up. Null or
    empty texts have size 0 and are not taken, nor is a source of size 0 (target 0).
    Rows of one id are separate documents; equal rows are interchangeable: they are counted, and more than `few` of them are written out in ranges by several
    tasks. An empty table gives an empty one. Other columns are not read; texts of any length are only counted and hashed.
    """
    _, counts = _counts(docs, weights, max_epochs, seed, id_col, text_col, source_col, few)
    return counts.select(F.col("_id").alias(id_col), "_stratum", "_key", F.col("_size").alias("size"), "source_size", "target", "times", (F.col("times") * F.col("_size")).alias("taken"))


def _counts(docs: DataFrame, weights: DataFrame | None, max_epochs: int, seed: int, id_col: str, text_col: str, source_col: str, few: int | None) -> tuple[Copies, DataFrame]:
    """Copies of equal rows, and for each row _id, SAME, _nth (among its equals; times don't rise with it), _size, source_size, target and times."""
    scratch = Scratch(docs.sparkSession, "mixing")
    same = [c.alias(n) for n, c in zip(SAME, same_rows(id_col, text_col, source_col, seed))]
    sized = docs.select(F.col(id_col).alias("_id"), n_words(text_col).alias("_size"), *same)
    # Equal rows are counted before they meet; groups and not rows are then put in order.
    sized = sized.groupBy("_id", "_size", *SAME).agg(F.count("*").alias("_copies")).withColumn("_bucket", F.substring("_key", 1, 3))
    sized = scratch.write(sized, "sized")
    copies = Copies(scratch, sized, SAME, few)
    words = F.col("_size") * F.col("_copies")

    buckets = scratch.write(sized.groupBy("_stratum", "_bucket").agg(F.sum(words).alias("_words")), "buckets")
    sources = buckets.groupBy("_stratum").agg(F.sum("_words").alias("source_size"))
    if weights is None:
        order = F.row_number().over(Window.orderBy("_stratum"))
        sources = sources.withColumn("weight", ((order - 1) % 3 + 1).cast("double"))
    else:
        given = weights.groupBy(stratum("source").alias("_stratum")).agg(F.sum(F.col("weight").cast("double")).alias("weight"))
        sources = sources.join(given, "_stratum", "left").withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)))
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs))).otherwise(0)
    plan = targets(sources, max_epochs).withColumn("_times", whole.cast("long"))
    plan = plan.withColumn("_rest", F.greatest(F.col("target") - F.col("_times") * F.col("source_size"), F.lit(0.0)))
    plan = scratch.write(plan, "plan")

    # What holds for a source reaches its documents by (source, bucket), so that no source meets in one task.
    by_bucket = buckets.select("_stratum", "_bucket").join(plan, "_stratum")
    known = sized.join(by_bucket, ["_stratum", "_bucket"]).withColumn("_long", F.col("_size") * LONG > F.col("source_size"))
    known = scratch.write(known, "known")
    offsets = bucket_offsets(known, ["_stratum", "_long"], "_bucket", words, "_kind_size", "_before")
    inside = Window.partitionBy("_stratum", "_long", "_bucket").orderBy("_key", "_size", "_none").rowsBetween(Window.unboundedPreceding, -1)
    groups = known.withColumn("_inside", F.coalesce(F.sum(words).over(inside), F.lit(0))).join(offsets, ["_stratum", "_long", "_bucket"])
    middle = F.col("_before") + F.col("_inside") + (F.col("_nth") - 1) * F.col("_size") + F.col("_size") / 2
    run = copies.write_out(groups).withColumn("_middle", middle)
    long_share = F.col("_rest") * F.col("_kind_size") / F.greatest(F.col("source_size"), F.lit(1))
    run = run.withColumn("_extra", F.col("_long") & (F.col("_size") > 0) & (F.col("_middle") <= long_share))
    run = scratch.write(run.drop("_before", "_inside", "_kind_size"), "run")

    got = run.where("_extra").groupBy("_stratum").agg(F.sum("_size").alias("_got"))
    got = buckets.select("_stratum", "_bucket").join(got, "_stratum")
    left = run.join(got, ["_stratum", "_bucket"], "left").withColumn("_left", F.col("_rest") - F.coalesce("_got", F.lit(0)))
    extra = F.col("_extra") | (~F.col("_long") & (F.col("_size") > 0) & (F.col("_middle") <= F.col("_left")))
    times = F.when(F.col("_size") > 0, F.least(F.col("_times") + extra.cast("long"), F.lit(max_epochs))).otherwise(0).cast("long")
    return copies, left.withColumn("times", times)


def mix_documents(
    docs: DataFrame,
    weights: DataFrame | None = None,
    max_epochs: int = 3,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    few: int | None = None,
) -> DataFrame:
    """The mixture itself: docs, each row as often as it is taken, all columns kept, whatever they are called.

    Rows of one id, source and text are interchangeable: the k-th of them is taken as often as their k-th count says; groups of more than `few` of them (or
    1/4096 of all) are numbered by several tasks. Nulls, weights and empty tables are handled as in mix_counts.
    """
    copies, counts = _counts(docs, weights, max_epochs, seed, id_col, text_col, source_col, few)
    rows = copies.fetch(docs, same_rows(id_col, text_col, source_col, seed), counts.where("times > 0"), F.col("times"))
    return rows.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_value").cast("int")))).select("_row.*")
