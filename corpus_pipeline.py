"""Corpus pipeline: from raw documents to packed token sequences.

Each stage takes ``(spark, docs, sf_dir)`` and calls one operator of
``valora.llm``; all but the last return rows with the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from valora.llm import language_id, mixing, packing, simhash, suffix_tree
from valora.session import ensure_checkpoint_dir, ship_package

#: No SQL restates the language model, the mix or the packing; the tests hold
#: the pipeline against a brute-force version.
ORACLE_SQL = None


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognised language."""
    ship_package(spark)
    return language_id.accept(docs, language_id.fit_outside(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    ship_package(spark)
    return simhash.representatives(docs, shingle=4, radius=4)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the words of passages that a document with a smaller id has."""
    ship_package(spark)
    return suffix_tree.shorten(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix of sources does."""
    return mixing.take(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of at most 2,048 tokens."""
    ship_package(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", languages),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("mixing", mixture),
    ("packing", sequences),
]


def _stored(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Written once and read again, in the shared folder of the session."""
    path = f"{ensure_checkpoint_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = _stored(spark, docs)
    return docs
