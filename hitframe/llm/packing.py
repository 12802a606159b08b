"""Hierarchical residual packing of token sequences.

Partitions pack their items best-fit; bins that are nearly full are emitted, the others become the items of the next
round, which has fewer partitions. A bin holds at most ``capacity`` tokens and so at most as many members: its members
travel with it, and no step needs all bins in one place.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitframe.llm.bpe import little_endian, rank_file
from hitframe.llm.common import map_partition, text_or_empty
from hitframe.session import written

MEMBER = "struct<doc_id: bigint, piece: int, start: bigint, length: bigint, ids_crc32: bigint, offset: bigint>"
#: Items that one task packs at most (on average), and the number of partitions that meet in one of the next round.
ITEMS, FAN_IN = 1 << 16, 8


def pieces(docs: DataFrame, path: str, pattern: str, end_id: int, capacity: int) -> DataFrame:
    """Ids of every document and ``end_id`` behind them, cut into pieces: doc_id, piece, start, length, ids_crc32.

    A document of at most ``capacity`` ids is one piece. A longer one is cut so that all pieces but the first have
    ``capacity`` ids. A null text is empty: one piece of one id.
    """

    def make(rows):
        ranks = rank_file(path, pattern)
        for key, value in rows:
            ids = ranks.ids(value)
            ids.append(end_id)
            data, n = little_endian(ids), len(ids)
            edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
            for k, (a, b) in enumerate(zip(edges, edges[1:])):
                yield key, k, a, b - a, zlib.crc32(data[4 * a : 4 * b])

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return map_partition(docs.select("doc_id", text_or_empty().alias("t")), make, ddl)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of item numbers: longest items first, each into the open bin with the least room that takes it."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: there is a bin with room r
    bins: list[list[int]] = []
    for i in order:
        size = lengths[i]
        above = rooms >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[k].append(i)
        else:
            room, k = capacity, len(bins)
            bins.append([i])
        if left := room - size:
            by_room[left].append(k)
            rooms |= 1 << left
    return bins


def pack_partition(rows: Iterator[tuple], capacity: int, nearly: int, level: int) -> Iterator[tuple]:
    """Bins (closed, sequence_id, fill, members) from the bins (fill, members) of a partition."""
    items = sorted(rows, key=lambda r: (-r[0], [(m["doc_id"] is None, m["doc_id"] or 0, m["piece"]) for m in r[1][:1]]))
    first = (level << 54) | (TaskContext.get().partitionId() << 30)
    for k, chosen in enumerate(best_fit([r[0] for r in items], capacity)):
        fill, members = 0, []
        for i in chosen:
            members += [m | {"offset": m["offset"] + fill} for m in items[i][1]]
            fill += items[i][0]
        yield fill >= nearly, first | k, fill, members


def pack(pieces: DataFrame, capacity: int = 1024, nearly: float = 1 - 1 / 64, items: int = ITEMS, fan_in: int = FAN_IN) -> DataFrame:
    """Place every piece (``doc_id, piece, start, length, ids_crc32``) in a sequence of at most ``capacity`` tokens.

    Adds ``sequence_id`` and ``offset``; offsets in a sequence are gapless from 0. Full pieces are sequences of their
    own. Bins filled to ``nearly`` leave after each round; the rest meets ``fan_in`` partitions at a time, until one
    partition is left or a round no longer joins bins. Every round is written to the shared folder, so a lost executor
    repeats only its own part and finds the same bins. No pieces: no rows.
    """
    short = pieces.where(F.col("length") < capacity)
    own = pieces.where(F.col("length") == capacity).select(
        *pieces.columns, (F.lit(1 << 62) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    member = F.struct("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("offset"))
    open_bins = short.select(F.col("length").cast("int").alias("fill"), F.array(member).alias("members"))
    count = open_bins.count()
    parts = max(1, math.ceil(count / items))
    ddl, least, level, done = f"closed boolean, sequence_id long, fill int, members array<{MEMBER}>", int(capacity * nearly), 0, []
    while count:
        made = map_partition(
            open_bins.select("fill", "members").repartition(parts),
            lambda rows, level=level: pack_partition(rows, capacity, least, level),
            ddl,
        )
        made = written(made, "bins")
        left = made.where(~F.col("closed"))
        before, count = count, left.count()
        if parts == 1 or count > 0.99 * before:
            done.append(made)
            break
        done.append(made.where("closed"))
        open_bins, level = left, level + 1
        parts = max(1, math.ceil(parts / fan_in), math.ceil(count / items))
    result = own
    for made in done:
        placed = made.select("sequence_id", F.explode("members").alias("m"))
        result = result.unionByName(placed.select("m.*", "sequence_id").select(*own.columns))
    return result


def pack_documents(docs: DataFrame, path: str, pattern: str, end_id: int, capacity: int = 1024) -> DataFrame:
    """``pieces`` of every document, then ``pack``. Repeated rows and null ids are packed like others."""
    return pack(written(pieces(docs, path, pattern, end_id, capacity), "pieces"), capacity)
