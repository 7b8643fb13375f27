"""From raw documents to sharded training text: quality rules, near-dedup, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. SQL cannot express the trees of the first stage
nor the sketches of the second, so there is no oracle; tests hold the stages against brute-force versions.

For every stage: an empty table gives an empty one, further columns pass through whatever they are called, texts are taken whole however long they
are, repeated rows are rows of their own, and no text is changed. What a stage does with nulls and ties is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.llm.common import Scratch
from barloom.llm.decontamination import decontaminate
from barloom.llm.mixing import mix_documents
from barloom.llm.near_dedup import drop_near_duplicates
from barloom.llm.quality import filter_quality, fit_quality
from barloom.llm.sharding import shard_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the base rules or the trees, fitted on the labels of these documents, reject.

    Null, empty and short texts go: the base rules reject them. Ids may be null or repeat; each row is judged by its text, so equal texts stay or go together.
    Without labels (an empty table, no id in common, ids whose labels disagree) the base rules alone decide.
    """
    return filter_quality(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group whose sets of five-word shingles are linked by a similarity of 0.8 or more.

    That with the smallest id stays. Rows of one id are one document, of which the longest text stays. Rows without an id, and texts without words,
    are linked with nothing and stay.
    """
    return drop_near_duplicates(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which 5 % of the words or more stand in passages of the benchmark.

    Null and empty texts have no words and stay; null or empty items hit nothing, and so does an empty benchmark.
    """
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take every source up to its target; a document that is taken twice has two rows.

    A null source is one of its own. Null and empty texts have size 0 and are not taken. Which rows are taken depends on ids and texts alone; of rows that
    are equal in both any may be.
    """
    return mix_documents(docs, max_epochs=3)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add shard (0 to 15) and slot; every shard has the mixture of the whole. Columns of those names are replaced.

    Nulls in any column are fine; rows that are equal in id, source and text are interchangeable.
    """
    return shard_documents(docs, n_shards=16)


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. Tables between the stages stay in the shared folder, for executors that are lost, until clear_scratch()."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.write(docs, f"stage{k}")
    return docs
