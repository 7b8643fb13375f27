"""Joins in time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, values: Sequence[str], block: str = "1 day") -> DataFrame:
    """left with the values of the last row of right at or before its time. No pairs: both sides are
    sorted together and the last right row is carried on. Of right rows at one time the one with the highest values counts.

    Rows are dealt by key and block of time, so that a key with a third of all rows fills no task; each block then gets the
    last right row of the blocks before it, which is found among one row a block. Rows of left without a time find nothing.
    """
    kept = [c for c in left.columns if c not in keys and c != time]
    at = F.window(F.col(time).cast("timestamp"), block)["start"].alias("_block")
    kind = right.select(F.struct(*values).alias("v")).schema["v"].dataType
    a = left.where(F.col(time).isNotNull()).select(*keys, time, at, F.lit(1).alias("_side"), F.struct(*kept).alias("_row"), F.lit(None).cast(kind).alias("_found"))
    b = right.where(F.col(time).isNotNull()).select(*keys, time, at, F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.struct(*values).alias("_found"))
    w = Window.partitionBy(*keys, "_block").orderBy(time, "_side", F.col("_found").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    inside = a.unionByName(b).withColumn("_last", F.last("_found", ignorenulls=True).over(w)).where("_side = 1")
    ends = a.select(*keys, "_block", F.lit(None).cast(b.schema[time].dataType).alias("_t"), "_found").unionByName(b.select(*keys, "_block", F.col(time).alias("_t"), "_found"))
    ends = ends.groupBy(*keys, "_block").agg(F.max(F.when(F.col("_t").isNotNull(), F.struct("_t", "_found"))).alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_block").alias("_b"), F.last("_end._found", ignorenulls=True).over(earlier).alias("_carried"))
    same = F.col("_block") == F.col("_b")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    last = F.coalesce("_last", "_carried")
    found = inside.join(carried, same, "left").select(*keys, time, "_row.*", *[last[v].alias(v) for v in values])
    lost = left.where(F.col(time).isNull()).select(*keys, time, *kept, *[F.lit(None).cast(kind[v].dataType).alias(v) for v in values])
    return found.unionByName(lost)


def positional(left: DataFrame, right: DataFrame, ordinal: str) -> DataFrame:
    """Rows with the same ordinal; the longer side is cut to the shorter."""
    return left.join(right, ordinal)
