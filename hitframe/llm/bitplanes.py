"""Token ids as shuffled planes: fixed-size blocks of ids are transposed into bit or byte planes, each compressed by zstandard.

A store has two tables in one folder: ``chunks`` (whole documents, at least one block each, in ascending order of their ids) and
``index`` (ids per shard). Both are Parquet files that Spark writes and reads, so any store that Spark reaches will do.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hitframe.llm.bpe import little_endian, rank_file
from hitframe.llm.common import map_partition, text_or_empty

#: Ids of a block, and ids after which a chunk is closed at the end of a document.
BLOCK, CHUNK = 1 << 16, 1 << 20
CHUNK_DDL = "shard int, chunk int, first long, n_ids long, planes array<array<binary>>, doc_ids array<bigint>, lengths array<bigint>"


def to_planes(ids: np.ndarray, unit: str) -> list[bytes]:
    """The planes of a block of unsigned 32-bit ids, lowest first; highest planes that are all zero are left out."""
    octets = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if unit == "byte":
        planes = [octets[:, k] for k in range(4)]
    else:
        planes = [np.packbits(b) for b in np.unpackbits(octets, axis=1, bitorder="little").T]
    while planes and not planes[-1].any():
        planes.pop()
    return [p.tobytes() for p in planes]


def from_planes(planes: list[bytes], n: int, unit: str) -> np.ndarray:
    """The ``n`` ids of a block."""
    octets = np.zeros((n, 4), np.uint8)
    if unit == "byte":
        for k, plane in enumerate(planes):
            octets[:, k] = np.frombuffer(plane, np.uint8)
    elif planes:
        bits = np.zeros((n, 32), np.uint8)
        for k, plane in enumerate(planes):
            bits[:, k] = np.unpackbits(np.frombuffer(plane, np.uint8), count=n)
        octets = np.packbits(bits, axis=1, bitorder="little")
    return octets.reshape(-1).view("<u4")


def encode_block(ids: np.ndarray, unit: str, level: int) -> list[bytes]:
    import zstandard

    pack = zstandard.ZstdCompressor(level=level)
    return [pack.compress(p) for p in to_planes(ids, unit)]


def decode_block(planes: list[bytes], n: int, unit: str) -> np.ndarray:
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    return from_planes([unpack.decompress(p) for p in planes], n, unit)


def chunks_of(docs: Iterator[tuple], unit: str, block: int, chunk: int, level: int) -> Iterator[tuple]:
    """Chunk rows of a partition from (doc_id, ids as bytes), in order."""
    shard, number, first = TaskContext.get().partitionId(), 0, 0
    held: list[tuple] = []
    size = 0

    def close():
        ids = np.frombuffer(b"".join(d for _, d in held), "<u4")
        planes = [encode_block(ids[a : a + block], unit, level) for a in range(0, len(ids), block)]
        return shard, number, first, len(ids), planes, [k for k, _ in held], [len(d) // 4 for _, d in held]

    for row in docs:
        held.append(row)
        size += len(row[1]) // 4
        if size >= chunk:
            yield close()
            first, number, held, size = first + size, number + 1, [], 0
    if held:
        yield close()


def write_store(
    docs: DataFrame, folder: str, path: str, pattern: str, end_id: int,
    unit: str = "byte", block: int = BLOCK, chunk: int = CHUNK, level: int = 3,
) -> None:
    """Encode every text, append ``end_id``, and write the store of all documents in ascending order of doc_id.

    Texts are range-partitioned and sorted by doc_id (null ids first, repeated ids next to each other); a partition writes
    its shard of chunks. A null text is empty. A task holds one chunk: ``chunk`` ids and the rest of the last document.
    """
    if unit not in ("bit", "byte"):
        raise ValueError(f"unit must be 'bit' or 'byte', not {unit!r}")

    def make(rows):
        ranks = rank_file(path, pattern)

        def encoded():
            for key, value in rows:
                ids = ranks.ids(value)
                ids.append(end_id)
                yield key, little_endian(ids)

        return chunks_of(encoded(), unit, block, chunk, level)

    ordered = docs.select("doc_id", text_or_empty().alias("t")).repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "t")
    map_partition(ordered, make, CHUNK_DDL).write.parquet(f"{folder}/chunks")
    spark = docs.sparkSession
    shards = spark.read.parquet(f"{folder}/chunks").groupBy("shard").agg(F.sum("n_ids").alias("n_ids"), F.count("*").alias("n_chunks"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    shards.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).write.parquet(f"{folder}/index")


def read_store(spark: SparkSession, folder: str, unit: str = "byte", block: int = BLOCK) -> DataFrame:
    """Read the ids back: doc_id, ``start`` (ids of all documents before it), ``n_tokens``, ``ids`` (little-endian bytes)."""
    return _read(spark, folder, unit, block, "ids binary", lambda data: data)


def read_digests(spark: SparkSession, folder: str, unit: str = "byte", block: int = BLOCK) -> DataFrame:
    """Like ``read_store`` with the crc32 of each document's ids instead of them."""
    return _read(spark, folder, unit, block, "ids_crc32 long", zlib.crc32)


def _read(spark, folder, unit, block, column, of) -> DataFrame:
    def make(rows):
        for shard, first, n, planes, doc_ids, lengths in rows:
            sizes = [min(block, n - a) for a in range(0, n, block)]
            data = b"".join(decode_block(p, k, unit).tobytes() for p, k in zip(planes, sizes))
            at = 0
            for key, length in zip(doc_ids, lengths):
                yield key, shard, first + at, length, of(data[4 * at : 4 * (at + length)])
                at += length

    chunks = spark.read.parquet(f"{folder}/chunks").select("shard", "first", "n_ids", "planes", "doc_ids", "lengths")
    rows = map_partition(chunks, make, f"doc_id long, shard int, local long, n_tokens long, {column}")
    index = spark.read.parquet(f"{folder}/index").select("shard", F.col("start").alias("base"))
    return rows.join(index, "shard").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", column.split()[0])
