"""Exact deduplication as a stateful stream: keyed state on disk, without expiry, holds for each digest the row that stays.

Everything here is DataFrame code. Arriving rows are logged (row number, digest, id, file); a streaming aggregation keeps
the first row and the number of rows of every digest in RocksDB; the state is then read as a table and joined with the log.
Digests that more than one row has are hits: for these the full texts are compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hitframe.session import scratch_path, written

#: Log bytes of a micro-batch.
BATCH_BYTES = 1 << 30
#: Up to so many hit keys (8 bytes each) are broadcast to filter the texts; beyond, they are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
#: State in RocksDB; it shall not reserve megabytes of disk for each of many small stores. The stores of an executor share one
#: bounded cache, and are closed soon after the stream has ended, not a minute later beside the next stage. Reading the state opens
#: a store for each partition too, so it needs the same settings as writing it.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    "spark.sql.streaming.stateStore.maintenanceInterval": "5s",
}


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(value: Column) -> Column:
    return F.sha2(value, 256)


@contextmanager
def bounded_stores(spark: SparkSession) -> Iterator[None]:
    """State stores that are opened inside have ``SETTINGS``."""
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def keep_state(log: DataFrame, checkpoint: str) -> None:
    """Feed a streaming ``log`` (row, doc_id, digest, file) to the state below ``checkpoint``; a later call goes on from there."""
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "file")  # null ids come last
    state = log.groupBy("digest").agg(F.min(first).alias("first"), F.count("*").alias("n"))
    with bounded_stores(log.sparkSession):
        sink = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint)
        sink.trigger(availableNow=True).start().awaitTermination()


def read_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """digest, ``first`` (the row that stays), ``n`` (rows so far). The stores are opened once: the rows are written as a table."""
    with bounded_stores(spark):
        state = spark.read.format("statestore").load(checkpoint)
        first, n = state.schema["value"].dataType.fieldNames()
        return written(state.select("key.digest", F.col("value")[first].alias("first"), F.col("value")[n].alias("n")), "kept")


def arrivals(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The log rows of documents: row, doc_id, digest, file."""
    return docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", digest(normalised(F.col("text"))).alias("digest"), F.input_file_name().alias("file")
    )


def collided(docs: DataFrame, state: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """Digests that different texts have: hits are compared by their full texts, one text per task and digest in the shuffle."""
    hits = state.where("n > 1").select(F.xxhash64("digest").alias("hit")).distinct()
    texts = docs.select(normalised(F.col("text")).alias("whole")).withColumn("digest", digest(F.col("whole")))
    few = hits.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    among = texts.join(F.broadcast(hits) if few else hits, F.xxhash64("digest") == F.col("hit"), "left_semi")
    ends = among.groupBy("digest").agg(F.min("whole").alias("low"), F.max("whole").alias("high"))
    return ends.where("low != high").select("digest")


def exact_duplicates(docs: DataFrame, digest: Callable[[Column], Column] = sha256, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when the same after each run of white space (space, tab to carriage return) is replaced by one space;
    null counts as empty. Of equal texts the row with the smallest doc_id stays (null ids last; of rows that repeat an id
    any single one). No documents: no rows. Columns other than doc_id and text are ignored.
    """
    spark = docs.sparkSession
    log_path, checkpoint = scratch_path(spark, "arrivals"), scratch_path(spark, "state")
    arrivals(docs, digest).write.parquet(log_path)
    return decide(spark, docs, log_path, checkpoint, digest, batch_bytes).drop("row")


def decide(spark: SparkSession, docs: DataFrame, log_path: str, checkpoint: str, digest=sha256, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Decisions on the rows of a written log, with their row numbers; ``docs`` gives the texts of hits."""
    log = spark.read.parquet(log_path)
    columns = ["row", "doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    if log.isEmpty():
        empty = log.withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long"), "kept": F.lit(True), "text_sha256": F.col("digest")})
        return empty.select(columns)
    stream = spark.readStream.schema(log.schema).option("maxBytesPerTrigger", batch_bytes).parquet(log_path)
    keep_state(stream, checkpoint)
    state = read_state(spark, checkpoint)
    joined = log.select("row", "doc_id", "digest").join(state, "digest").select(
        "row", "doc_id", F.col("first.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("row") == F.col("first.row")).alias("kept"), F.col("digest").alias("text_sha256"), "digest",
    )
    wrong = collided(docs, state, digest).cache()
    if wrong.isEmpty():
        return joined.select(columns)
    by_text = Window.partitionBy("digest", "whole")
    ordered = by_text.orderBy(F.col("doc_id").asc_nulls_last(), "row")
    texts = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", normalised(F.col("text")).alias("whole"))
    apart = texts.withColumn("digest", digest(F.col("whole"))).join(wrong, "digest", "left_semi").select(
        "row", "doc_id", F.first("doc_id").over(ordered).alias("keep_id"), F.count("*").over(by_text).alias("group_size"),
        (F.row_number().over(ordered) == 1).alias("kept"), sha256(F.col("whole")).alias("text_sha256"),
    )
    return joined.join(wrong, "digest", "left_anti").select(columns).unionByName(apart)


def without_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns. A copy of the rows with row numbers is written first."""
    spark = docs.sparkSession
    copy, log_path, checkpoint = (scratch_path(spark, n) for n in ("rows", "arrivals", "state"))
    docs.withColumn("__row", F.monotonically_increasing_id()).write.parquet(copy)
    rows = spark.read.parquet(copy)
    log = rows.select(F.col("__row").alias("row"), "doc_id", sha256(normalised(F.col("text"))).alias("digest"), F.input_file_name().alias("file"))
    log.write.parquet(log_path)
    dropped = decide(spark, docs, log_path, checkpoint).where(~F.col("kept")).select(F.col("row").alias("__row"))
    few = dropped.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return rows.join(F.broadcast(dropped) if few else dropped, "__row", "left_anti").drop("__row")
