"""A corpus pipeline over ``documents``: each stage works on all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitframe.llm import language_mixture, ngram_join, packing, secret_scan, stream_dedup
from hitframe.llm.common import small_batches
from hitframe.llm.queries import CAPACITY, RANKS, SEPARATOR, language_model, ranks, table
from hitframe.session import written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without a letter (null and empty texts too) go."""
    small_batches(spark)
    return docs.where(language_mixture.language(language_model(docs)) != language_mixture.UNKNOWN)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id stays."""
    return stream_dedup.without_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the smallest id stays."""
    return ngram_join.one_of_each_group(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are masked, and ``n_chars`` is that of the new text."""
    masked = secret_scan.redacted(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each in its sequence."""
    return packing.pack_documents(docs, *ranks(RANKS), SEPARATOR, CAPACITY)


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: Language shares, tokens and packing are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
