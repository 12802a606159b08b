"""Incremental ingest of landing event files.

Spark's file stream tracks which files were taken (exactly once, through the query's checkpoint). Only path and length
travel from it; the bytes are decoded by the tasks, a file in as many record ranges as its size asks for.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from hitframe.schema import EVENTS
from hitframe.sources.compact import decode_bytes
from hitframe.sources.decode import file_number
from hitframe.sources.fixed import decode_piece

LISTING = "path string, modificationTime timestamp, length long, content binary"


def landing_events(
    spark: SparkSession,
    path: str,
    layout: str = "fixed",
    group: bool = False,
    min_energy: float | None = None,
    split_bytes: int = 128 << 20,
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """Streaming DataFrame of nested events from files that appear below ``path``.

    Event identity is (event_id, file_id) as for files read in a batch: ``file_id`` is the same 64-bit hash of the path.
    Compact files cannot be entered in the middle and are one range each.
    """
    reader = spark.readStream.format("binaryFile").schema(LISTING)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    files = reader.load(path).select("path", "length")
    if layout == "compact":
        step, pieces = F.col("length"), F.array(F.lit(0).cast("bigint"))
    else:
        step = F.lit(split_bytes)
        last = F.greatest(F.col("length") - 1, F.lit(0))
        pieces = F.sequence(F.lit(0).cast("bigint"), last, step)
    ranges = files.withColumn("start", F.explode(pieces)).withColumn("stop", F.least(F.col("start") + step, "length"))
    sides = 1 if group else 2

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _decode_piece(row, layout, sides, min_energy)

    return ranges.repartition(F.col("path"), F.col("start")).mapInArrow(decode, EVENTS)


def _decode_piece(row: dict, layout: str, sides: int, min_energy: float | None) -> Iterator[pa.RecordBatch]:
    path, start, stop = row["path"], row["start"], row["stop"]
    if layout == "compact":
        yield from decode_bytes(path, file_number(path), start, stop, 0, sides, min_energy, "permissive")
        return
    yield from decode_piece(path, file_number(path), row["length"], start, stop, sides, min_energy)


def append_to_table(events: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Writer that appends a stream of (filtered, featured) events as Parquet."""
    return (
        events.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
