"""Small text and binary table files: skew, pair map, calibration, slab categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAIR_BYTES = 8
#: Pairs of a category file that are cut at a time.
BLOCK_PAIRS = 1 << 14


def read_skew(spark: SparkSession, path: str) -> DataFrame:
    """Whitespace-separated ``channel skew`` without header."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(parts[0].cast("int").alias("channel"), parts[1].cast("double").alias("skew"))


def read_lor_skew(spark: SparkSession, path: str) -> DataFrame:
    """Comma-separated with header ``Pair,Skew``."""
    table = spark.read.csv(path, header=True, schema="Pair int, Skew double", enforceSchema=False)
    return table.select(F.col("Pair").alias("pair"), F.col("Skew").alias("skew"))


def read_pair_map(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated without header: pair id, first region, second region."""
    return spark.read.csv(path, sep="\t", schema="p int, s0 int, s1 int")


def read_calibration(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Tab-separated with header; ``mu`` and ``poly`` are keyed by ``id``, ``slab`` by (time_ch, slab)."""
    if kind == "mu":
        return _keyed(spark, path, "ID int, mu double")
    if kind == "poly":
        table = _keyed(spark, path, "ID int, coef0 double, coef1 double, coef2 double")
        return table.withColumnsRenamed({"coef0": "c0", "coef1": "c1", "coef2": "c2"})
    if kind != "slab":
        raise ValueError(f"unknown calibration kind {kind!r}")
    table = spark.read.csv(path, sep="\t", header=True, schema="`ID(t_ch, slab)` string, mu double")
    key = F.col("`ID(t_ch, slab)`")
    pair = r"\(\s*(-?\d+)\s*,\s*(-?\d+)\s*\)"
    return table.select(
        F.regexp_extract(key, pair, 1).cast("int").alias("time_ch"),
        F.regexp_extract(key, pair, 2).cast("int").alias("slab"),
        "mu",
    )


def _keyed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema=schema).withColumnRenamed("ID", "id")


def read_slab_categories(spark: SparkSession, path: str) -> DataFrame:
    """Flat binary pairs of little-endian 32-bit integers: slab id, category; an incomplete last pair is left out.

    The content is cut into blocks, blocks into pairs, both as bytes: a cut at any place costs the same, and only one
    block's pairs are in memory.
    """
    word = lambda text, at: F.conv(
        F.concat(*[F.substring(text, at + 2 * k, 2) for k in (3, 2, 1, 0)]), 16, 10
    ).cast("bigint")
    signed = lambda v: F.when(v >= 1 << 31, v - (1 << 32)).otherwise(v).cast("int")
    content = spark.read.format("binaryFile").load(path).select("content")
    blocks = content.select(F.explode(_pieces("content", BLOCK_PAIRS * PAIR_BYTES, partial=True)).alias("block"))
    pairs = blocks.select(F.explode(_pieces("block", PAIR_BYTES)).alias("pair")).select(F.hex("pair").alias("pair"))
    return pairs.select(signed(word(F.col("pair"), 1)).alias("slab_id"), signed(word(F.col("pair"), 9)).alias("category"))


def _pieces(column: str, size: int, partial: bool = False) -> Column:
    """Array of consecutive pieces of ``size`` bytes; ``partial`` keeps a shorter last one."""
    ends = F.length(column) + F.lit(size - 1 if partial else 0)
    count = F.floor(ends / size).cast("int")
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substr(column, i * size + 1, F.lit(size)))
