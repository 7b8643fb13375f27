"""Line dedup over levelled sorted runs of line hashes.

Documents come in batches. A batch becomes a table of (hash of a line's key, number of its documents that
have the line), merge-anti-joined against the runs: what the runs already hold as frequent needs no more
counting. The rest is written as a new sorted run of level 0, and whenever a level has two runs
they are compacted into one run of the next level, so that n batches leave O(log n) runs. At the end the runs left
are compacted into one, whose frequent lines a second scan of the texts drops.

Runs are tables bucketed and sorted by hash, all into the same number of buckets: a batch's anti-joins and the full outer joins that compact are
merge joins that meet bucket by bucket, and neither shuffle nor sort a run.

A line's key is the line without white space at its ends and with A-Z lower-cased, in UTF-8; its hash has 128 bits.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import partial

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, Scratch, split_hot_join

#: Keys that one worker holds before it passes on their counts.
HELD = 200_000
#: Buckets of the runs: at least, at most, and the counted rows that one is made for.
LEAST_BUCKETS, MOST_BUCKETS, BUCKET_ROWS = 8, 50_000, 4_000_000


def line_key(line: bytes) -> bytes:
    return line.strip(SPACE).lower()


def lines_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split(b"\n")


def _hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _count(batches: Iterator[pa.RecordBatch], n_batches: int, min_chars: int) -> Iterator[pa.RecordBatch]:
    """Rows (batch, hash, n): in how many documents of that batch, among those just read, the line is."""
    held: list[dict[bytes, int]] = [{} for _ in range(n_batches)]

    def out() -> Iterator[pa.RecordBatch]:
        for b, counts in enumerate(held):
            if counts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b] * len(counts), pa.int32()), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["batch", "hash", "n"]
                )
                counts.clear()

    for batch in batches:
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            keys = set(map(line_key, lines_of(text.as_py())))
            counts = held[xxhash.xxh32_intdigest(str(name)) % n_batches]
            for key in keys:
                if key and (min_chars <= 1 or len(key.decode("utf-8", "surrogatepass")) >= min_chars):
                    h = _hash(key)
                    counts[h] = counts.get(h, 0) + 1
            if sum(map(len, held)) > HELD:
                yield from out()
    yield from out()


@contextmanager
def _sorted_scans(spark: SparkSession):
    """While it holds, the scan of a bucket that is one sorted file counts as sorted."""
    key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class LineRuns:
    """The runs: tables (hash, n), bucketed and sorted by hash, in levels. They are tables of the session's catalog with files in the shared folder."""

    def __init__(self, scratch: Scratch, threshold: int, buckets: int = LEAST_BUCKETS):
        self.scratch, self.threshold, self.buckets = scratch, threshold, buckets
        self.spark = scratch.spark
        self.levels: list[list[str]] = []

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def unsettled(self, batch: DataFrame) -> DataFrame:
        """The batch's sums, without what one of the runs has as frequent. Dealt by hash once, like the runs."""
        new = batch.repartition(self.buckets, "hash").groupBy("hash").agg(F.sum("n").alias("n"))
        for run in self.runs():
            new = new.join(run.where(F.col("n") >= self.threshold).select("hash").hint("merge"), "hash", "left_anti")
        return new

    def merged(self, a: str, b: str) -> DataFrame:
        other = self.spark.table(b).withColumnRenamed("n", "m").hint("merge")
        return self.spark.table(a).join(other, "hash", "full").select("hash", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))

    def _write(self, df: DataFrame, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        name = f"barloom_run_{uuid.uuid4().hex}"
        with _sorted_scans(self.spark):
            df.write.bucketBy(self.buckets, "hash").sortBy("hash").option("path", f"{self.scratch.root}/{name}").saveAsTable(name)
        self.levels[level].append(name)

    def add(self, batch: DataFrame) -> None:
        """batch: (hash, n). What one of the runs has as frequent is settled and dropped; the rest is added."""
        self._write(self.unsettled(batch), 0)
        level = 0
        while len(self.levels[level]) == 2:
            self._compact(level, level + 1)
            level += 1

    def _compact(self, level: int, to: int) -> None:
        pair, self.levels[level] = self.levels[level], []
        self._write(self.merged(*pair), to)
        self._drop(pair)

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"drop table {name}")
            self.scratch.delete(name)

    def frequent(self) -> DataFrame:
        """The hashes that are frequent; compacts the runs into one."""
        for level in range(len(self.levels) - 1):
            self.levels[level + 1] += self.levels[level]
            self.levels[level] = []
            if len(self.levels[level + 1]) == 2:
                self._compact(level + 1, level + 1)
        return self.spark.table(self.levels[-1][0]).where(F.col("n") >= self.threshold).select("hash")

    def clear(self) -> None:
        for level in self.levels:
            self._drop(level)
        self.levels = []


def frequent_lines(docs: DataFrame, min_docs: int, min_chars: int, n_batches: int, id_col: str, text_col: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The hashes of the lines that at least min_docs documents have; and (hash, n), the counts of all lines in parts."""
    slim = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    counted = slim.mapInArrow(partial(_count, n_batches=n_batches, min_chars=min_chars), "batch int, hash binary, n long")
    # Counts of one batch meet in the same few files, so that each batch then reads only its own.
    counted = scratch.write(counted, "lines", partition_by=("batch",))
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, counted.count() // BUCKET_ROWS))
    runs = LineRuns(scratch, min_docs, buckets)
    for b in range(n_batches):
        runs.add(counted.where(F.col("batch") == b).select("hash", "n"))
    frequent = scratch.write(runs.frequent(), "frequent")
    runs.clear()
    return frequent, counted.select("hash", "n")


def _drop_lines(batches: Iterator[pa.RecordBatch], frequent) -> Iterator[pa.RecordBatch]:
    known = frequent.value if frequent is not None else None
    for batch in batches:
        texts, n_lines, n_dropped = [], [], []
        marks = batch.column("_frequent").to_pylist() if known is None else None
        for i, text in enumerate(batch.column("_text")):
            lines = lines_of(text.as_py())
            gone = known if known is not None else frozenset(marks[i] or ())
            kept = [x for x in lines if not ((key := line_key(x)) and _hash(key) in gone)] if gone else lines
            texts.append(b"\n".join(kept))
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(kept))
        rest = [batch.column(i) for i, name in enumerate(batch.schema.names) if name not in ("_text", "_frequent")]
        names = [name for name in batch.schema.names if name not in ("_text", "_frequent")]
        made = [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
        yield pa.RecordBatch.from_arrays(rest + made, [*names, "kept_text", "n_lines", "n_dropped"])


def _line_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (_key, hash): the lines of a text, which goes by its own hash. Texts without any have no row."""
    for batch in batches:
        names, hashes = [], []
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            for key in set(map(line_key, lines_of(text.as_py()))):
                if key:
                    names.append(name)
                    hashes.append(_hash(key))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(hashes, pa.binary())], ["_key", "hash"])


def drop_frequent_lines(
    docs: DataFrame,
    min_docs: int = 10,
    min_chars: int = 1,
    n_batches: int = 8,
    broadcast_rows: int = 1_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Drop in every document the lines whose key has min_chars code points or more and is in min_docs documents or more.

    Returns id, the columns named in keep, kept_text (the other lines joined by \\n), n_lines (before) and n_dropped. A null or empty
    text is one empty line, and stays as an empty text. Each row counts as a document of its own, also where ids
    repeat or are null. An empty table gives an empty one; keep may not name the results. A text of any length is taken whole by one worker.
    Up to broadcast_rows frequent lines are broadcast, as a set of about 100 bytes each in every worker; more of them are joined
    to the texts' lines, and each text fetches those it has.
    """
    if {"kept_text", "n_lines", "n_dropped"} & set(keep):
        raise ValueError("kept_text, n_lines and n_dropped are results; keep can't name them")
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    frequent, counted = frequent_lines(docs, min_docs, min_chars, n_batches, id_col, text_col, scratch)
    out = docs.select(id_col, *keep, F.col(text_col).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields[:-1])
    schema = f"{fields}, kept_text string, n_lines long, n_dropped long"
    if frequent.count() <= broadcast_rows:
        known = spark.sparkContext.broadcast(frozenset(bytes(r.hash) for r in frequent.toLocalIterator()))
        return out.mapInArrow(partial(_drop_lines, frequent=known), schema)
    # Equal texts have equal lines, so lines are fetched once a text. What holds for a line in a third of all texts, or a text in a third of all rows, is broadcast.
    key = F.md5(F.col("_text").cast("binary")).alias("_key")
    sizes = scratch.write(counted.groupBy("hash").agg(F.sum("n").alias("copies")).join(frequent, "hash", "left_semi"), "sizes")
    lines = scratch.write(out.select(key, "_text").mapInArrow(_line_hashes, "_key string, hash binary").distinct(), "text-lines")
    marks = split_hot_join(lines, sizes, "hash", "copies", lines.count()).groupBy("_key").agg(F.collect_set("hash").alias("_frequent"))
    copies = out.select(key).groupBy("_key").agg(F.count("*").alias("_copies"))
    marks = scratch.write(marks.join(copies, "_key"), "marks")
    found = split_hot_join(out.withColumn("_key", key), marks, "_key", "_copies", docs.count(), how="left").drop("_copies")
    found = found.unionByName(out.where("_text is null").withColumn("_key", F.lit(None).cast("string")), allowMissingColumns=True).drop("_key")
    return found.mapInArrow(partial(_drop_lines, frequent=None), schema)
