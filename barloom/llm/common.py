"""What the operators of this package share: the shared folder, written tables, byte-level text rules."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import shared_dir

#: `[\x20\x09-\x0D]`, the white space of every contract here; bytes.split() and bytes.strip() use the same six.
SPACE = b" \t\n\x0b\x0c\r"

_folders: dict[str, list[str]] = {}


class Scratch:
    """Written tables of one query, in the shared folder. They cut the lineage and survive lost executors.

    A query's result reads them when it is used, so they stay until clear_scratch().
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        _folders.setdefault(spark.sparkContext.applicationId, []).append(self.root)

    def write(self, df: DataFrame, tag: str = "t", partition_by: tuple[str, ...] = ()) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}-{tag}"
        writer = df.write.partitionBy(*partition_by) if partition_by else df.write
        writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._barloom_path = path
        return out

    def delete(self, name: str) -> None:
        _delete(self.spark, f"{self.root}/{name}")

    def drop(self, df: DataFrame) -> None:
        """Delete a table that nothing will read again."""
        _delete(self.spark, df._barloom_path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete the tables of all queries of this session. For the caller, once the results are written: a DataFrame that is not would lose its input."""
    for folder in _folders.pop(spark.sparkContext.applicationId, []):
        _delete(spark, folder)


def stratum(source: str = "source") -> Column:
    """A grouping key that is never null: null sources get one of their own, after all others in code point order."""
    return F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source).cast("string")))


def bucket_offsets(df: DataFrame, group: list[str], bucket: str, amount: Column, total: str, before: str) -> DataFrame:
    """For each (group, bucket): the sum of amount in earlier buckets of the group, and in the whole group.

    A running sum over a group of any size then needs a window inside one bucket only, so no
    group, however large, meets in one task. The table has as many rows as there are buckets.
    """
    part = df.groupBy(*group, bucket).agg(F.sum(amount).alias("_amount"))
    w = Window.partitionBy(*group)
    upto = F.sum("_amount").over(w.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))
    return part.select(
        *group, bucket, F.coalesce(upto, F.lit(0)).cast("long").alias(before), F.sum("_amount").over(w).alias(total)
    )


def split_hot_join(left: DataFrame, right: DataFrame, key: str, copies: str, rows: int, parts: int = 4096, how: str = "inner") -> DataFrame:
    """left join right on key, where right has each key once and `copies` counts the rows of left that have it.

    Keys of more than max(64, rows / parts) rows are fewer than `parts`, whatever the data, so they
    are broadcast; the others are dealt by key and none of them fills a task. how: inner or left; rows of left without a key
    are left out by either.
    """
    limit = max(64, rows // parts)
    hot = right.where(F.col(copies) > limit)
    rest = right.where(F.col(copies) <= limit)
    marked = left.where(F.col(key).isNotNull()).join(F.broadcast(hot.select(key, F.lit(True).alias("_hot"))), key, "left")
    common = marked.where("_hot").drop("_hot").join(F.broadcast(hot), key)
    others = marked.where("_hot is null").drop("_hot").join(rest, key, how)
    return common.unionByName(others)


#: Rows of one key that a task may hold, and copies that one row is written out to at a time.
FEW = 10_000


class Copies:
    """Rows that are alike in the columns `same` have one row in `counted`, with their number as _copies.

    Rows that agree in the columns are interchangeable, so the k-th of them may take the k-th of anything that the group has.
    """

    def __init__(self, scratch: Scratch, counted: DataFrame, same: list[str], few: int | None = None):
        self.scratch, self.counted, self.same, self.few = scratch, counted, same, few or FEW
        n = counted.agg(F.sum("_copies").alias("rows"), F.max("_copies").alias("most")).first()
        self.most, self.limit = n["most"] or 0, max(self.few, (n["rows"] or 0) // 4096)

    def write_out(self, df: DataFrame) -> DataFrame:
        """A row for each of _copies, numbered from 1 in _nth. A row of many copies is dealt in ranges, so that no task writes out all of it."""
        if self.most <= self.few:
            return df.withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).drop("_copies")
        df = self.scratch.write(df, "groups")
        few = df.where(F.col("_copies") <= self.few).withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), "_copies")))
        many = df.where(F.col("_copies") > self.few).withColumn("_range", F.explode(F.expr(f"sequence(0L, (_copies - 1) div {self.few})")))
        first = F.col("_range") * self.few + 1
        many = many.repartition(*self.same, "_range").withColumn("_nth", F.explode(F.sequence(first, F.least(F.col("_copies"), first + (self.few - 1)))))
        return few.unionByName(many.drop("_range")).drop("_copies")

    def fetch(self, docs: DataFrame, keys: list[Column], found: DataFrame, value: Column) -> DataFrame:
        """Each row of docs as _row, with the _value that the row of its number has in found(same, _nth).

        keys are the columns `same` as docs gives them. found has the numbers of a group from 1 without a gap; rows past them are left out. Groups of up to
        max(few, rows / 4096) rows meet in a task. Larger ones are fewer than 4096, whatever the data: they are told apart by a broadcast, their rows are written
        once more with the number of the task that did so, and take their numbers by it.
        """
        # A map can't be hashed; rows that differ in maps alone keep the order in which they are read.
        plain = [f"`{f.name}`" for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
        rows = docs.select(F.struct(*docs.columns).alias("_row"), *[k.alias(n) for n, k in zip(self.same, keys)], F.xxhash64(*plain).alias("_order"))
        nth = F.row_number().over(Window.partitionBy(*self.same).orderBy("_order"))
        found = found.select(*self.same, "_nth", value.alias("_value"))
        if self.most <= self.limit:
            return self._by_list(rows.withColumn("_at", nth), found)
        hot = self.counted.where(F.col("_copies") > self.limit).select(*self.same, F.lit(True).alias("_hot"))
        marked, found = (d.join(F.broadcast(hot), self.same, "left") for d in (rows, found))
        rest = self._by_list(marked.where("_hot is null").drop("_hot").withColumn("_at", nth), found.where("_hot is null").drop("_hot"))
        many = self.scratch.write(marked.where("_hot").drop("_hot").withColumn("_task", F.spark_partition_id()), "hot")
        by = [*self.same, "_task"]
        before = F.sum("_n").over(Window.partitionBy(*self.same).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
        tasks = many.groupBy(*by).agg(F.count("*").alias("_n")).select(*by, F.coalesce(before, F.lit(0)).alias("_before"))
        many = many.withColumn("_at", F.row_number().over(Window.partitionBy(*by).orderBy("_order"))).join(tasks, by)
        many = many.withColumn("_nth", F.col("_before") + F.col("_at")).join(found.where("_hot").drop("_hot"), [*self.same, "_nth"])
        return rest.unionByName(many.select("_row", "_value"))

    def _by_list(self, rows: DataFrame, found: DataFrame) -> DataFrame:
        lists = found.groupBy(*self.same).agg(F.array_sort(F.collect_list(F.struct("_nth", "_value"))).alias("_values"))
        return rows.join(lists, self.same).where(F.col("_at") <= F.size("_values")).select("_row", F.element_at("_values", F.col("_at"))["_value"].alias("_value"))


def least_count(counts: DataFrame, most: int) -> int:
    """The lowest n that at most `most` rows reach; found from a few thousand sums at most. counts: (n)."""
    step = F.when(F.col("n") < 1024, F.col("n")).otherwise(F.floor(F.pow(F.lit(2.0), F.floor(F.log2("n") * 16) / 16)))
    found = 0
    least = 1 << 62
    for r in sorted(counts.groupBy(step.cast("long").alias("at")).count().collect(), key=lambda r: -r["at"]):
        found += r["count"]
        if found > most:
            break
        least = r["at"]
    return least
