"""Compact event files: hit counters of one byte per side, directly followed by the hits.

A record can only be found by walking the counters before it. Without an index a file is one split; with an index
(see ``split_index``) each indexed byte range is one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from hitframe.schema import EVENTS
from hitframe.sources.decode import HIT_DTYPE, MODES, base_name, event_batch, file_number, list_files, numbered_files, open_fs
from hitframe.sources.fixed import cleaned

HIT_BYTES = HIT_DTYPE.itemsize
#: Bytes that a task decodes at a time; what it holds is about ten times that.
READ_BYTES = 1 << 20
#: Tasks over which the splits of an index are dealt.
MOST_TASKS = 10_000


def walk(data: bytes, sides: int, start: int = 0) -> tuple[list[int], int]:
    """Offsets of the complete records in ``data`` and the offset behind the last of them."""
    offsets, at, end = [], start, len(data)
    while at + sides <= end:
        hits = data[at] if sides == 1 else data[at] + data[at + 1]
        behind = at + sides + hits * HIT_BYTES
        if behind > end:
            break
        offsets.append(at)
        at = behind
    return offsets, at


def _split_hits(data: np.ndarray, offsets: np.ndarray, end: int, sides: int):
    """Flat hits and counts per side of complete records: drop the counter bytes, then deal the hits out."""
    counts = np.stack([data[offsets + s] for s in range(sides)], axis=1).astype(np.int64)
    is_counter = np.zeros(end, bool)
    for s in range(sides):
        is_counter[offsets + s] = True
    hits = data[:end][~is_counter].view(HIT_DTYPE)
    owner = np.repeat(np.tile(np.arange(sides), len(offsets)), counts.reshape(-1))
    return [(hits[owner == s], counts[:, s]) for s in range(sides)]


def _torn_tail(rest: bytes, sides: int):
    """The last, incomplete record: a side whose hit block is cut off is empty, a later side then too."""
    at, parts = sides, []
    for s in range(sides):
        behind = at + rest[s] * HIT_BYTES
        whole = behind <= len(rest)
        hits = np.frombuffer(rest[at:behind] if whole else b"", HIT_DTYPE)
        parts.append((hits, np.array([len(hits)], np.int64)))
        at = behind
    return parts


def decode_bytes(
    path: str, file_id: int, start: int, stop: int, first_event: int, sides: int, min_energy: float | None, mode: str
) -> Iterator[pa.RecordBatch]:
    """Events of a byte range that starts at a record, read in chunks."""
    store, bare = open_fs(path)
    name, event = base_name(path), first_event
    with store.open_input_file(bare) as f:
        f.seek(start)
        left, pending = stop - start, b""
        while left > 0:
            chunk = f.read(min(READ_BYTES, left))
            if not chunk:
                break
            left -= len(chunk)
            pending += chunk
            offsets, end = walk(pending, sides)
            if offsets:
                parts = _split_hits(np.frombuffer(pending, np.uint8), np.array(offsets), end, sides)
                sound = np.zeros(len(offsets), bool)
                yield event_batch(name, file_id, event, parts, sound, min_energy)
                event += len(offsets)
            pending = pending[end:]
    if not pending:
        return
    if len(pending) < sides:
        # Not even a full counter: there is no event to report, only a damaged file.
        if mode == "failfast":
            raise ValueError(f"{path} ends inside a counter")
        return
    yield from cleaned(
        event_batch(name, file_id, event, _torn_tail(pending, sides), np.ones(1, bool), min_energy), mode
    )


@dataclass
class ByteRange(InputPartition):
    path: str
    file_id: int
    start: int
    stop: int
    first_event: int

    def __post_init__(self):
        super().__init__(self.path)


@dataclass
class IndexRows(InputPartition):
    file: str
    group: int
    first: int
    count: int

    def __post_init__(self):
        super().__init__(self.file)


def check_covered(index: str, sizes: dict[str, int]) -> frozenset[str]:
    """An error for a file that the index doesn't have in its present size; the index's files that are not listed."""
    store, bare = open_fs(index)
    table = ds.dataset(bare, filesystem=store, format="parquet")
    missing, others = {path for path, size in sizes.items() if size}, set()
    for batch in table.to_batches(columns=["path", "file_bytes"], filter=ds.field("start") == 0):
        for path, size in zip(*(c.to_numpy(zero_copy_only=False) for c in batch.columns)):
            if path not in sizes:
                others.add(path)
            elif sizes[path] == size:
                missing.discard(path)
    if missing:
        raise ValueError(f"the split index does not cover {min(missing)}; build it again")
    return frozenset(others)


class CompactReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.sides = 1 if options.get("group", "false").lower() == "true" else 2
        threshold = options.get("min_energy")
        self.min_energy = None if threshold is None else float(threshold)
        self.index = options.get("index")
        self.not_listed: frozenset[str] = frozenset()
        self.mode = options.get("mode", "permissive").lower()
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")

    def partitions(self) -> list[InputPartition]:
        files = numbered_files(self.path)
        if self.index:
            ranges = self._indexed(files)
        else:
            ranges = [ByteRange(path, number, 0, size, 0) for path, size, number in files if size]
        return ranges or [ByteRange("", -1, 0, 0, 0)]

    def _indexed(self, files) -> list[InputPartition]:
        """Rows of the index by row group and position; a task reads the splits that its rows name.

        Only the listing, the index's footers and its first row of each file pass through the driver.
        """
        self.not_listed = check_covered(self.index, {path: size for path, size, _ in files})
        groups = []
        for file, _ in list_files(self.index):
            store, bare = open_fs(file)
            with store.open_input_file(bare) as f:
                footer = pq.ParquetFile(f).metadata
            groups += [(file, g, footer.row_group(g).num_rows) for g in range(footer.num_row_groups)]
        step = max(1, -(-sum(n for *_, n in groups) // MOST_TASKS))
        return [IndexRows(file, g, at, min(step, n - at)) for file, g, n in groups for at in range(0, n, step)]

    def _read_indexed(self, rows: IndexRows):
        store, bare = open_fs(rows.file)
        with store.open_input_file(bare) as f:
            splits = pq.ParquetFile(f).read_row_group(rows.group, columns=["path", "start", "stop", "first_event"])
        for path, start, stop, first in zip(*(c.to_pylist() for c in splits.slice(rows.first, rows.count).columns)):
            if path not in self.not_listed:
                yield from decode_bytes(path, file_number(path), start, stop, first, self.sides, self.min_energy, self.mode)

    def read(self, partition):
        if isinstance(partition, IndexRows):
            yield from self._read_indexed(partition)
            return
        if partition.stop <= partition.start:
            return
        yield from decode_bytes(
            partition.path,
            partition.file_id,
            partition.start,
            partition.stop,
            partition.first_event,
            self.sides,
            self.min_energy,
            self.mode,
        )


class CompactEvents(DataSource):
    """``spark.read.format("compact_events")``.

    Options: ``group`` and ``mode`` as for fixed files, ``min_energy`` (inclusive hit threshold, none by default),
    and ``index``, the path of a split index table.
    A torn last record is reported as an event with ``corrupt`` set and the cut side empty.
    """

    @classmethod
    def name(cls) -> str:
        return "compact_events"

    def schema(self):
        return EVENTS

    def reader(self, schema) -> DataSourceReader:
        return CompactReader(self.options)
