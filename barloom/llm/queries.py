"""The registered queries of this package and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontamination import mark_contamination
from .filter_audit import audit_filters
from .html_text import extract_text
from .language_model import score_documents
from .lexical_search import build_index, search
from .line_dedup import drop_frequent_lines
from .mixing import mix_counts
from .near_dedup import link_documents
from .oracles import ORACLE_SQL
from .quality import fit_quality, judge_quality
from .secrets import builtin_samples, corpus_words, digest, fit_ratios, scan_secrets
from .sharding import shard_rows
from .token_counts import count_tokens
from .url_filters import judge_urls

__all__ = ["ORACLE_SQL", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard_rows(_table(spark, sf_dir, "documents"), n_shards=16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_frequent_lines(_table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_counts(_table(spark, sf_dir, "documents"), max_epochs=3)
    return out.select("doc_id", "size", "source_size", "target", "taken", "times")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return out.withColumn("over_limit", F.col("n_tokens") > 1024)


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(_table(spark, sf_dir, "documents"), size=4, percent=80)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mark_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=13, min_share=20)
    digest = F.sha2(F.array_join("items", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    ratios = fit_ratios(builtin_samples(spark).unionByName(corpus_words(docs)))
    found = scan_secrets(docs, ratios)
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(digest(F.col("base")), 256).alias("base_sha256"),
        digest(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return judge_quality(docs, fit_quality(docs, _table(spark, sf_dir, "labels")))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


#: Host, path, action.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, action string"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "benchmark"), k=20)


QUERIES: dict[str, Query] = {
    "op1_sharding": op1_sharding,
    "op2_line_dedup": op2_line_dedup,
    "op3_mixing": op3_mixing,
    "op4_token_counts": op4_token_counts,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_secret_scans": op7_secret_scans,
    "op8_html_extraction": op8_html_extraction,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_quality_rules": op10_quality_rules,
    "op11_filter_audit": op11_filter_audit,
    "op12_url_filters": op12_url_filters,
    "op13_lexical_search": op13_lexical_search,
}
