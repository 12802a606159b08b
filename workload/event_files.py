"""Writing hits as event files, so that the file sources can be checked on the given tables.

Each task writes one file from its sorted rows as they stream by; nothing passes through the driver but file names.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitframe.schema import MAX_HITS_PER_SIDE
from hitframe.sources.decode import HIT_DTYPE, open_fs


def make_folder(path: str) -> None:
    store, bare = open_fs(path)
    store.create_dir(bare, recursive=True)


@contextmanager
def published(folder: str, name: str):
    """Output stream whose file appears under its name only when it is complete.

    A task that runs again replaces the file of its earlier attempt, because the name depends on its partition alone.
    """
    store, bare = open_fs(folder)
    partial = f"{bare}/_{uuid.uuid4().hex}"
    with store.open_output_stream(partial) as f:
        yield f
    store.move(partial, f"{bare}/{name}")


def _whole_events(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(side, hits, event starts) of complete events, carrying an event that is cut by a batch boundary."""
    carried = None
    for batch in batches:
        t = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
        t = {n: v if carried is None else np.concatenate([carried[n], v]) for n, v in t.items()}
        starts = np.flatnonzero(np.diff(t["event_id"], prepend=t["event_id"][:1] - 1)) if len(t["event_id"]) else []
        if len(starts) == 0:
            continue
        last = starts[-1]
        carried = {n: v[last:] for n, v in t.items()}
        if last:
            yield _taken({n: v[:last] for n, v in t.items()}, starts[:-1])
    if carried is not None and len(carried["event_id"]):
        yield _taken(carried, np.array([0]))


def _taken(t: dict, starts: np.ndarray):
    hits = np.empty(len(t["time"]), HIT_DTYPE)
    for n in HIT_DTYPE.names:
        hits[n] = t[n]
    return t["side"], hits, starts


def _counts(side: np.ndarray, starts: np.ndarray, group: bool) -> np.ndarray:
    sides = [np.ones(len(side), np.int64)] if group else [(side == 1).astype(np.int64), (side == 2).astype(np.int64)]
    counts = np.stack([np.add.reduceat(s, starts) for s in sides], axis=1)
    if counts.max() > MAX_HITS_PER_SIDE:
        raise ValueError(f"an event side holds more than {MAX_HITS_PER_SIDE} hits and does not fit the format")
    return counts


def _compact(side, hits, starts, group: bool) -> bytes:
    counts = _counts(side, starts, group)
    parts, at = [], 0
    for row in counts:
        n = int(row.sum())
        parts += [bytes(row.tolist()), hits[at : at + n].tobytes()]
        at += n
    return b"".join(parts)


def _fixed(side, hits, starts, group: bool, hit_limit: int) -> bytes:
    counts = _counts(side, starts, group)
    if counts.max() > hit_limit:
        raise ValueError(f"an event side holds more than {hit_limit} hits")
    n_sides = counts.shape[1]
    record = np.dtype([("n", "u1", (n_sides,)), ("hits", HIT_DTYPE, (n_sides, hit_limit))])
    out = np.zeros(len(counts), record)
    out["hits"]["channel"] = -1
    out["n"] = counts
    owner = np.repeat(np.arange(len(counts)), counts.sum(axis=1))
    which = np.zeros(len(side), np.int64) if group else side.astype(np.int64) - 1
    flat = owner * n_sides + which
    first = np.concatenate([[0], np.flatnonzero(np.diff(flat)) + 1])
    place = np.arange(len(flat)) - np.repeat(first, np.diff(np.append(first, len(flat))))
    out["hits"][owner, which, place] = hits
    return out.tobytes()


#: Parts into which the events of one value are dealt.
SALTS = 16
#: Hits of a file where a least number of files is asked for.
FILE_HITS = 1 << 20


def write_event_files(
    hits: DataFrame,
    path: str,
    layout: str,
    group: bool = False,
    hit_limit: int | None = None,
    tail: bytes = b"",
    by: str | None = None,
    torn: int | None = None,
) -> None:
    """Write events as files; ``tail`` is appended to each, or to ``torn`` of them. With ``by`` a file holds one value of that column and the
    value is part of its name; events of one value are dealt over several files. Without ``hit_limit`` fixed records are as long as the longest
    event side needs. The number of files is that of the shuffle's partitions, which adaptive execution takes from the size; with ``torn`` there
    are that many at least, and one for every ``FILE_HITS`` hits."""
    make_folder(path)
    if layout == "fixed" and hit_limit is None:
        side = ["event_id"] if group else ["event_id", "side"]
        hit_limit = hits.groupBy(*side).count().agg(F.max("count")).first()[0] or 0
    keys = ["event_id"] if by is None else [by, "event_id"]
    placed = hits.select(*keys, "side", "hit_idx", "time", "energy", "channel")
    dealt = ["event_id"] if by is None else [by, F.pmod(F.xxhash64("event_id"), F.lit(SALTS))]
    files = [] if torn is None else [max(torn, -(-placed.count() // FILE_HITS))]
    spread = placed.repartition(*files, *dealt).sortWithinPartitions(*keys, "side", "hit_idx").drop("hit_idx")

    def encode(side, h, starts) -> bytes:
        return _compact(side, h, starts, group) if layout == "compact" else _fixed(side, h, starts, group, hit_limit)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for value, part in _by_value(batches, by):
            part_id = TaskContext.get().partitionId()
            name = f"run_{part_id}.ldat" if by is None else f"run_pos{value}_{part_id}.ldat"
            with published(path, name) as f:
                if layout == "fixed":
                    f.write(struct.pack("<i", hit_limit))
                for events in _whole_events(part):
                    f.write(encode(*events))
                if torn is None or part_id < torn:
                    f.write(tail)
            yield pa.RecordBatch.from_pydict({"name": [name]})

    spread.mapInArrow(write, "name string").count()


def _by_value(batches: Iterator[pa.RecordBatch], by: str | None):
    """Runs of equal ``by`` in sorted batches, one batch at a time."""
    if by is None:
        yield None, batches
        return

    def parts():
        for batch in batches:
            values = batch.column(by).to_numpy(zero_copy_only=False)
            for v in np.unique(values):
                yield int(v), batch.filter(pa.array(values == v)).drop_columns([by])

    for value, run in groupby(parts(), key=itemgetter(0)):
        yield value, (batch for _, batch in run)
