"""Split index of compact files: where every k-th event starts.

The counters of a file can only be walked in order, but a walk needs little from what lies before: where the first record of
a byte range starts. So every range is walked at once from each place at which a record could start, which gives a map from
entry to exit and number of events (walks that meet go on as one). Maps of neighbouring ranges are composed, ``FAN`` at
a time, until a file has few; then entries are handed down again, and each range names the starts of its splits. A file is thus
indexed by as many tasks as it has ranges, and later reads use any number of splits per file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hitframe.schema import MAX_HITS_PER_SIDE
from hitframe.session import written
from hitframe.sources.compact import HIT_BYTES, walk
from hitframe.sources.decode import list_files, open_fs

#: Bytes of a file that one row of work covers, maps that are composed at once, and walks up to which each goes on by itself.
RANGE_BYTES, FAN, FEW_WALKS = 16 << 20, 64, 4

MAP_SCHEMA = "path string, place long, exits binary, counts binary"
ENTRY_SCHEMA = "path string, place long, entry long, event long"
START_SCHEMA = "path string, file_bytes long, start long, first_event long, closing boolean"


def longest_record(sides: int) -> int:
    return sides + sides * MAX_HITS_PER_SIDE * HIT_BYTES


def read_range(path: str, start: int, length: int, sides: int) -> bytes:
    """The bytes of a range and, as far as the file goes, of a record that starts at its last byte."""
    store, bare = open_fs(path)
    with store.open_input_file(bare) as f:
        f.seek(start)
        return f.read(length + longest_record(sides))


def leave(data: bytes, at: int, length: int, sides: int) -> tuple[int, int]:
    """Where a walk from ``at`` leaves a range, and the events on its way; a record cut by the file's end leads to the end."""
    n, end = 0, len(data)
    while at < length:
        if at + sides > end:
            return end, n
        at += sides + HIT_BYTES * sum(data[at : at + sides])
        if at > end:
            return end, n
        n += 1
    return at, n


def range_map(data: bytes, length: int, sides: int, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """Exit behind the range and number of events, for walks from each of the first ``entries`` bytes of it."""
    raw, end, limit = np.frombuffer(data, np.uint8), len(data), longest_record(sides)
    at, owner, counts = np.arange(entries, dtype=np.int64), np.arange(entries), np.zeros(entries, np.int64)
    edge = 0
    while edge < length and len(at) > FEW_WALKS:
        # All walks pass the edge, then those at the same place go on as one.
        edge = min(edge + limit, length)
        n = np.zeros(len(at), np.int64)
        moving = np.flatnonzero(at < edge)
        while len(moving):
            here = at[moving]
            counter = here[:, None] + np.arange(sides)
            inside = counter[:, -1] < end
            hits = raw[np.minimum(counter, end - 1)].astype(np.int64).sum(axis=1)
            behind = here + sides + HIT_BYTES * hits
            whole = inside & (behind <= end)
            n[moving] += whole
            at[moving] = np.where(whole, behind, end)
            moving = moving[whole & (behind < edge)]
        counts += n[owner]
        at, merged = np.unique(at, return_inverse=True)
        owner = merged[owner]
    rest = [leave(data, int(a), length, sides) for a in at]
    exits = np.array([a for a, _ in rest], np.int64)
    return exits[owner] - length, counts + np.array([n for _, n in rest], np.int64)[owner]


def _maps_of(group: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    ordered = group.sort_values("place")
    for place, exits, counts in zip(ordered["place"], ordered["exits"], ordered["counts"]):
        yield place, np.frombuffer(exits, "<i4"), np.frombuffer(counts, "<i8")


def composed(group: pd.DataFrame) -> pd.DataFrame:
    """One map of neighbouring ones."""
    exits = counts = None
    for _, to, n in _maps_of(group):
        if exits is None:
            exits, counts = to, n
        else:
            exits, counts = to[exits], counts + n[exits]
    first = group.iloc[0]
    return pd.DataFrame([(first["path"], first["above"], exits.tobytes(), counts.tobytes())], columns=["path", "place", "exits", "counts"])


def resolved(group: pd.DataFrame) -> pd.DataFrame:
    """Entry and number of the first event of neighbouring ranges, from those of the first."""
    first = group.iloc[0]
    entry, event, rows = int(first["entry"]), int(first["event"]), []
    for place, to, n in _maps_of(group):
        rows.append((first["path"], place, entry, event))
        entry, event = int(to[entry]), event + int(n[entry])
    return pd.DataFrame(rows, columns=["path", "place", "entry", "event"])


def entries_of(maps: DataFrame, most: int, fan: int) -> DataFrame:
    """Entries of all ranges; ``most`` is the largest number of maps of a file. No group has more than ``fan`` maps."""
    placed = maps.withColumn("above", F.floor(F.col("place") / fan))
    if most <= fan:
        known = placed.withColumns({"entry": F.lit(0).cast("long"), "event": F.lit(0).cast("long")})
    else:
        up = placed.groupBy("path", "above").applyInPandas(composed, MAP_SCHEMA)
        known = placed.join(entries_of(up, -(-most // fan), fan).withColumnRenamed("place", "above"), ["path", "above"])
    return known.groupBy("path", "above").applyInPandas(resolved, ENTRY_SCHEMA)


def range_maps(ranges: DataFrame, range_bytes: int, sides: int) -> DataFrame:
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, size, place in zip(batch["path"], batch["size"], batch["place"]):
                start = place * range_bytes
                length = min(range_bytes, size - start)
                exits, counts = range_map(read_range(path, start, length, sides), length, sides, longest_record(sides) if place else 1)
                row = (path, place, exits.astype("<i4").tobytes(), counts.astype("<i8").tobytes())
                yield pd.DataFrame([row], columns=["path", "place", "exits", "counts"])

    return ranges.mapInPandas(make, MAP_SCHEMA)


def split_starts(entered: DataFrame, range_bytes: int, sides: int, events_per_split: int) -> DataFrame:
    """Starts of the splits in each range, and behind the last range of a file its size and number of events."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, size, place, entry, event in batch[["path", "size", "place", "entry", "event"]].itertuples(index=False):
                base = place * range_bytes
                length = min(range_bytes, size - base)
                found, _ = walk(read_range(path, base, length, sides), sides, entry)
                offsets = np.array(found, np.int64)
                offsets = offsets[offsets < length]
                taken = np.arange(-event % events_per_split, len(offsets), events_per_split)
                rows = [(path, size, base + int(offsets[k]), event + int(k), False) for k in taken]
                if place == 0 and not rows:  # no whole record, but a torn one is still to be read
                    rows.append((path, size, 0, 0, False))
                if base + length == size:
                    rows.append((path, size, size, event + len(offsets), True))
                yield pd.DataFrame(rows, columns=["path", "file_bytes", "start", "first_event", "closing"])

    return entered.mapInPandas(make, START_SCHEMA)


def split_index(
    spark: SparkSession, path: str, events_per_split: int = 1_000_000, group: bool = False, range_bytes: int = RANGE_BYTES, fan: int = FAN
) -> DataFrame:
    """Index rows of all compact files below ``path``: path, file_bytes, start, stop, first_event, n_events.

    Write the result as Parquet and pass it as option ``index``. The last split of a file also covers a torn tail. Files of at
    most ``range_bytes`` are read once, larger ones twice.
    """
    sides = 1 if group else 2
    range_bytes = max(range_bytes, longest_record(sides))
    listed = [(p, size) for p, size in list_files(path) if size]
    most = max((-(-size // range_bytes) for _, size in listed), default=1)
    n_ranges = sum(-(-size // range_bytes) for _, size in listed)
    files = spark.createDataFrame(listed, "path string, size long")
    places = F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / range_bytes))
    ranges = files.withColumn("place", F.explode(places)).repartition(max(1, min(n_ranges, 10_000)), "path", "place")

    whole = F.col("size") <= range_bytes
    zero = F.lit(0).cast("long")
    entered = ranges.where(whole).withColumns({"entry": zero, "event": zero})
    if most > 1:
        cut = ranges.where(~whole)
        maps = written(range_maps(cut, range_bytes, sides), "range-maps")
        entered = entered.unionByName(cut.join(entries_of(maps, most, fan), ["path", "place"]))
    starts = split_starts(entered, range_bytes, sides, events_per_split)
    w = Window.partitionBy("path").orderBy("first_event", "start")
    follows = starts.withColumns({"stop": F.lead("start").over(w), "behind": F.lead("first_event").over(w)})
    n_events = (F.col("behind") - F.col("first_event")).alias("n_events")
    return follows.where(~F.col("closing")).select("path", "file_bytes", "start", "stop", "first_event", n_events)
