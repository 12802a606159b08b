"""Fixed-size event files: ``int32 hit_limit`` and then equal records, so any record range is a split."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from hitframe.schema import EVENTS
from hitframe.sources.decode import HIT_DTYPE, MODES, base_name, event_batch, numbered_files, open_fs

HEADER_BYTES = 4


def record_bytes(hit_limit: int, sides: int) -> int:
    return sides + sides * hit_limit * HIT_DTYPE.itemsize


def read_hit_limit(path: str) -> int | None:
    """Hit limit of a file, None if the file is too short to hold one."""
    store, bare = open_fs(path)
    with store.open_input_file(bare) as f:
        head = f.read(HEADER_BYTES)
    return int(np.frombuffer(head, "<i4")[0]) if len(head) == HEADER_BYTES else None


def decode_range(
    path: str, file_id: int, first: int, count: int, sides: int, min_energy: float | None, batch_records: int = 10_000
) -> Iterator[pa.RecordBatch]:
    """Events of a record range, read and decoded in batches."""
    hit_limit = read_hit_limit(path)
    size = record_bytes(hit_limit, sides)
    store, bare = open_fs(path)
    record = np.dtype([("n", "u1", (sides,)), ("hits", HIT_DTYPE, (sides, hit_limit))])
    with store.open_input_file(bare) as f:
        f.seek(HEADER_BYTES + first * size)
        while count > 0:
            n = min(count, batch_records)
            data = np.frombuffer(f.read(n * size), record)
            if len(data) == 0:
                return
            # A counter above the limit cannot be true; only hit_limit slots exist.
            wrong = (data["n"] > hit_limit).any(axis=1)
            taken = np.minimum(data["n"].astype(np.int64), hit_limit)
            used = np.arange(hit_limit) < taken[:, :, None]
            parts = [(data["hits"][:, s][used[:, s]], taken[:, s]) for s in range(sides)]
            yield event_batch(base_name(path), file_id, first, parts, wrong, min_energy)
            first, count = first + len(data), count - len(data)


def decode_piece(
    path: str, file_id: int, size: int, start: int, stop: int, sides: int, min_energy: float | None
) -> Iterator[pa.RecordBatch]:
    """Events whose records start in a byte range of a file of ``size`` bytes."""
    if size < HEADER_BYTES:
        return
    width = record_bytes(read_hit_limit(path), sides)
    records = (size - HEADER_BYTES) // width

    def first_record_from(offset: int) -> int:
        return min(max(-((HEADER_BYTES - offset) // width), 0), records)

    first, behind = first_record_from(start), first_record_from(stop)
    if behind > first:
        yield from decode_range(path, file_id, first, behind - first, sides, min_energy)


@dataclass
class FilePiece(InputPartition):
    path: str
    file_id: int
    size: int
    start: int
    stop: int

    def __post_init__(self):
        super().__init__(self.path)


class FixedReader(DataSourceReader):
    """Splits are byte ranges from the file listing alone; a task finds the records that start in its range."""

    def __init__(self, options):
        self.path = options["path"]
        self.sides = 1 if options.get("group", "false").lower() == "true" else 2
        threshold = options.get("min_energy")
        self.min_energy = None if threshold is None else float(threshold)
        self.split_bytes = int(options.get("split_bytes", 128 << 20))
        self.mode = options.get("mode", "permissive").lower()
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")

    def partitions(self) -> list[InputPartition]:
        pieces = [
            FilePiece(path, file_id, size, start, min(start + self.split_bytes, size))
            for path, size, file_id in numbered_files(self.path)
            for start in range(0, size, self.split_bytes)
        ]
        return pieces or [FilePiece("", -1, 0, 0, 0)]

    def read(self, partition):
        p = partition
        if self.mode == "failfast" and p.size >= HEADER_BYTES and p.stop == p.size:
            if (p.size - HEADER_BYTES) % record_bytes(read_hit_limit(p.path), self.sides):
                raise ValueError(f"{p.path} ends inside a record")
        for batch in decode_piece(p.path, p.file_id, p.size, p.start, p.stop, self.sides, self.min_energy):
            yield from cleaned(batch, self.mode)


def cleaned(batch: pa.RecordBatch, mode: str) -> Iterator[pa.RecordBatch]:
    """Apply the read mode to the events flagged as corrupt."""
    corrupt = batch.column("corrupt")
    if mode != "permissive" and corrupt.true_count:
        if mode == "failfast":
            raise ValueError(f"corrupt event in {batch.column('file_name')[0]}")
        batch = batch.filter(pc.invert(corrupt))
    yield batch


class FixedEvents(DataSource):
    """``spark.read.format("fixed_events")``.

    Options: ``group`` (one side per event), ``min_energy`` (inclusive hit threshold, none by default),
    ``split_bytes``, ``mode`` (``permissive``, ``dropmalformed``, ``failfast``). A partial last record is not an event.
    """

    @classmethod
    def name(cls) -> str:
        return "fixed_events"

    def schema(self):
        return EVENTS

    def reader(self, schema) -> DataSourceReader:
        return FixedReader(self.options)
