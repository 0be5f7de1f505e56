"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valora.llm import (fill_middle, fingerprints, hnsw, language_id, line_runs, merkle, mixing, packing, sharding, simhash,
                        suffix_array, suffix_tree, url_filter)
from valora.session import ship_package


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = language_id.predict(docs, language_id.fit_outside(docs))
    return out.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.neighbours(_table(spark, sf_dir, "embeddings"), k=20, every=20)


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, radius=4)


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.deduplicate(_table(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target",
                      (F.col("size") * F.col("copies")).alias("taken"), "source", "rate", "copies")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.deduplicate(_table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), url_filter.RULES)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(_table(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_runs.deduplicate(line_runs.file_batches(_table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tamper_check(_table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.transform(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(fill_middle.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_nearest_neighbours": op2_nearest_neighbours,
        "op3_simhash_near_dedup": op3_simhash_near_dedup,
        "op4_suffix_array_dedup": op4_suffix_array_dedup,
        "op5_fingerprints": op5_fingerprints,
        "op6_mixing": op6_mixing,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_url_filter": op8_url_filter,
        "op9_sharding": op9_sharding,
        "op10_packing": op10_packing,
        "op11_line_dedup": op11_line_dedup,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_fill_in_middle": op13_fill_in_middle,
    }


def oracle_sql() -> dict[str, str]:
    """Only these can be restated; the others are tested against brute
    force, an exact round trip or held-out accuracy."""
    return {
        "op4_suffix_array_dedup": suffix_array.ORACLE,
        "op7_substring_dedup": suffix_tree.ORACLE,
        "op8_url_filter": url_filter.ORACLE,
        "op11_line_dedup": line_runs.ORACLE,
        "op13_fill_in_middle": fill_middle.ORACLE,
    }
