"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import re
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an output batch; a batch is also closed at about this many characters of its strings and bytes of its arrays.
OUT_ROWS, OUT_CHARS = 4096, 2 << 20


#: Rows of a batch that goes to Python where rows are long texts, bytes at which it is closed before that, and rows that are read from a file at a time.
TEXT_ROWS, TEXT_BYTES, READ_ROWS = 1000, 2 << 20, 512
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": TEXT_ROWS,
    "spark.sql.execution.arrow.maxBytesPerBatch": TEXT_BYTES,
    "spark.sql.parquet.columnarReaderBatchSize": READ_ROWS,
}
#: Writer options of tables whose rows are megabytes: pages and row groups are measured after every row, not after a hundred.
LARGE_ROWS = {"parquet.block.size": 4 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}


def small_batches(spark: SparkSession) -> None:
    """Batches of at most ``BATCHES`` from now on: a task's batches of texts, and what the allocators keep of them, stay small."""
    for name, most in BATCHES.items():
        now = int(re.match(r"-?\d+", spark.conf.get(name))[0])
        if now <= 0 or now > most:
            spark.conf.set(name, str(most))


def per_worker(key, make: Callable):
    """The value of ``make()``, kept for the life of a Python worker; tasks of one worker share it."""
    kept = sys.modules.setdefault("_hitframe_worker", types.ModuleType("_hitframe_worker")).__dict__.setdefault("kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow form of a schema; only the driver can read the text, so tasks get the result."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def weight(row: tuple) -> int:
    return sum(v.nbytes if isinstance(v, np.ndarray) else len(v) for v in row if isinstance(v, (str, bytes, np.ndarray)))


def give_back() -> None:
    """Free memory of a Python worker back to the system when a task ends: idle workers stay beside later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only the GNU library has it
        pass


def batches_of(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded size from row tuples."""
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += weight(row)
        if len(held) >= OUT_ROWS or chars >= OUT_CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def rows_of(batch: pa.RecordBatch, step: int = 256) -> Iterator[tuple]:
    """Row tuples of a batch; only a few hundred rows are Python objects at a time."""
    for at in range(0, batch.num_rows, step):
        yield from zip(*(c.to_pylist() for c in batch.slice(at, step).columns))


def map_partition(df: DataFrame, make: Callable[[Iterator[tuple]], Iterator[tuple]], ddl: str) -> DataFrame:
    """``make`` turns the row tuples of a partition into row tuples of ``ddl``, streaming through Arrow batches."""

    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in rows_of(batch))
        yield from batches_of(make(rows), schema)
        give_back()

    return df.mapInArrow(run, ddl)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """True for rows whose crc32(doc_id as text) mod ``folds`` is 0; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds == 0
