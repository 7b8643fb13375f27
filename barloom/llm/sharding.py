"""Sharding by proportional stratified interleaving.

Rows are put in a seeded order within each source; the r-th of n rows has the fractional rank
(r - 0.5) / n. All rows sorted by fractional rank form one sequence in which every stretch has the
sources in their overall proportions, so cutting it into equal stretches gives shards that match
the mixture and whose row counts differ by one at most (law `rows`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Copies, Scratch, bucket_offsets, stratum

#: Stretches of the fractional rank that are counted first and ordered one by one.
STRETCHES = 4096

#: Rows that agree in these have the same source, id and text (a null text being as good as an empty one).
SAME = ["_stratum", "_key", "_none"]


def shuffle_key(seed: int, id_col: str, text_col: str) -> Column:
    """A hexadecimal digest of id and text that orders rows; its first three digits deal them to 4096 buckets. Only rows of one id and text share it."""
    text = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.lit(":"), text).cast("binary"))


def same_rows(id_col: str, text_col: str, source_col: str, seed: int) -> list[Column]:
    """The columns SAME of a row of documents."""
    return [stratum(source_col), shuffle_key(seed, id_col, text_col), F.col(id_col).isNull()]


def _placed(docs: DataFrame, n_shards: int, seed: int, id_col: str, text_col: str, source_col: str, few: int | None) -> tuple[Copies, DataFrame]:
    """Copies of equal rows, and for each row _id, _size, _crc, SAME, _nth (among its equals), shard and slot."""
    scratch = Scratch(docs.sparkSession, "sharding")
    keys = docs.select(
        F.col(id_col).alias("_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("_size"),
        F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long").alias("_crc"),
        *[c.alias(n) for n, c in zip(SAME, same_rows(id_col, text_col, source_col, seed))],
    )
    # Equal rows are counted before they meet; groups and not rows are then put in order.
    keys = keys.groupBy("_id", "_size", "_crc", *SAME).agg(F.count("*").alias("_copies")).withColumn("_bucket", F.substring("_key", 1, 3))
    keys = scratch.write(keys, "keys")
    copies = Copies(scratch, keys, SAME, few)

    offsets = bucket_offsets(keys, ["_stratum"], "_bucket", F.col("_copies"), "_n", "_before")
    w = Window.partitionBy("_stratum", "_bucket").orderBy("_key", "_crc", "_size", "_none").rowsBetween(Window.unboundedPreceding, -1)
    groups = keys.withColumn("_inside", F.coalesce(F.sum("_copies").over(w), F.lit(0))).join(offsets, ["_stratum", "_bucket"]).drop("_bucket")
    ranked = copies.write_out(groups).withColumn("_f", (F.col("_before") + F.col("_inside") + F.col("_nth") - F.lit(0.5)) / F.col("_n"))
    ranked = ranked.select("_id", "_size", "_crc", *SAME, "_nth", "_f", F.floor(F.col("_f") * STRETCHES).alias("_stretch"))
    ranked = scratch.write(ranked, "ranked")

    stretches = ranked.groupBy("_stretch").agg(F.count("*").alias("_amount"))
    all_before = Window.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    stretches = stretches.select(
        "_stretch",
        F.coalesce(F.sum("_amount").over(all_before), F.lit(0)).alias("_before"),
        F.sum("_amount").over(Window.partitionBy()).alias("_total"),
    )
    place = F.row_number().over(Window.partitionBy("_stretch").orderBy("_f", "_key", "_stratum", "_crc", "_size", "_none"))
    placed = ranked.join(stretches, "_stretch").withColumn("_pos", F.col("_before") + place - 1)
    placed = placed.withColumn("shard", F.expr(f"cast((_pos * {n_shards}) div _total as int)"))
    slot = F.expr(f"_pos - (shard * _total + {n_shards - 1}) div {n_shards}").cast("long")
    return copies, placed.withColumn("slot", slot)


def shard_rows(
    docs: DataFrame, n_shards: int = 16, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", few: int | None = None
) -> DataFrame:
    """id, size, text_crc32, shard and slot of every row.

    size is UTF-8 bytes plus 1 (null text: 1), text_crc32 the CRC of the UTF-8 bytes (null text: that
    of no bytes, 0). Null sources form one stratum. Rows of one id and text share a place in the order, and those
    that are equal in every respect are interchangeable: they are counted, and more than `few` of them are written out in ranges by several tasks.
    Equal texts of different ids may fall into different shards: the method deals rows of a source evenly and knows no other groups. An empty table gives
    an empty one. Columns other than the three named are not read; texts of any length are only hashed.
    """
    _, placed = _placed(docs, n_shards, seed, id_col, text_col, source_col, few)
    return placed.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), "shard", "slot", "_stratum", "_key")


def shard_documents(
    docs: DataFrame, n_shards: int = 16, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", few: int | None = None
) -> DataFrame:
    """docs with two more columns, shard and slot; columns of those names are replaced.

    Long texts are moved once: the order is made from slim keys, and the rows then fetch their places.
    Rows with the same id, source and text are interchangeable, so the k-th of them takes the k-th place; groups of more than `few` of them (or 1/4096 of
    all) are numbered by several tasks. Nulls and empty tables are handled as in shard_rows.
    """
    docs = docs.drop("shard", "slot")
    copies, placed = _placed(docs, n_shards, seed, id_col, text_col, source_col, few)
    found = copies.fetch(docs, same_rows(id_col, text_col, source_col, seed), placed, F.struct("shard", "slot"))
    return found.select("_row.*", "_value.shard", "_value.slot")
