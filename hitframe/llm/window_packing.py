"""Sum-of-squares online packing of token sequences into windows of one capacity.

A window's fill level is the number of tokens in it. The level array holds how many open windows each level has; a document
goes, as it comes, to the level that leaves the sum of squares of that array smallest (a new window has level 0, full ones
are not counted). So windows of all levels stay in stock, and most documents find one that they fill exactly.

A task packs its own rows and keeps open windows only. Where there are too many of them, and at the end, the open windows of a level (at
the end, of all) are laid end to end and cut at the capacity, so none of them needs padding. What is left of a partition, less than one window, is cut
into sequences whose lengths are powers of two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame

from hitframe.llm.bpe import little_endian, rank_file
from hitframe.llm.common import map_partition, text_or_empty

#: Open windows of a task; with 8 KB of ids at most in each, they fit in 32 MB.
OPEN = 4096
DDL = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: Cost of a level that has no window.
NEVER = 1 << 60


class LevelArray:
    """Counts of open windows by fill level, kept as the costs that a choice compares.

    Taking a window from level h changes the sum of squares by ``1 - 2 N[h]``, adding one to level h by ``2 N[h] + 1``.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, np.int64)
        self.taken = np.full(capacity + 1, NEVER, np.int64)
        self.taken[0] = 0  # a new window
        self.added = np.ones(capacity + 1, np.int64)
        self.added[capacity] = 0  # full windows are not counted

    def change(self, level: int, by: int) -> None:
        """``by`` more (or fewer) open windows at a level other than 0 and the capacity."""
        n = self.counts[level] = self.counts[level] + by
        self.taken[level] = 1 - 2 * n if n else NEVER
        self.added[level] = 2 * n + 1

    def choose(self, size: int) -> int:
        """The level for a document of ``size`` tokens; of equally good ones the fullest."""
        costs = self.taken[: self.capacity - size + 1] + self.added[size:]
        return len(costs) - 1 - int(np.argmin(costs[::-1]))


class Packer:
    """Windows of one task. ``put`` and ``end`` give the pieces of the windows that they close: rows of ``DDL``."""

    def __init__(self, capacity: int, first_id: int, most_open: int = OPEN):
        self.capacity, self.next_id, self.most_open = capacity, first_id, most_open
        self.levels = LevelArray(capacity)
        self.stock: list[list] = [[] for _ in range(capacity + 1)]  # by level: windows, each a list of pieces
        self.open = 0

    def close(self, pieces: list) -> Iterator[tuple]:
        """``pieces`` (doc_id, start, ids, doc_tokens) as one sequence."""
        offset, sequence = 0, self.next_id
        self.next_id += 1
        for doc, start, ids, total in pieces:
            yield doc, start, len(ids) // 4, ids, total, sequence, offset
            offset += len(ids) // 4

    def keep(self, level: int, pieces: list) -> None:
        self.stock[level].append(pieces)
        self.levels.change(level, 1)
        self.open += 1

    def take(self, level: int) -> list:
        self.levels.change(level, -1)
        self.open -= 1
        return self.stock[level].pop()

    def put(self, doc, ids: bytes) -> Iterator[tuple]:
        """A document's ids, which are 4 bytes each; what is longer than a window fills windows of its own first."""
        total, step = len(ids) // 4, 4 * self.capacity
        whole = len(ids) // step * step
        for at in range(0, whole, step):
            yield from self.close([(doc, at // 4, ids[at : at + step], total)])
        size = total - whole // 4
        if not size:
            return
        level = self.levels.choose(size)
        pieces = self.take(level) if level else []
        pieces.append((doc, whole // 4, ids[whole:], total))
        if level + size == self.capacity:
            yield from self.close(pieces)
            return
        self.keep(level + size, pieces)
        if self.open > self.most_open:
            fullest = int(np.argmax(self.levels.counts))
            yield from self.relay([fullest] if self.levels.counts[fullest] > 1 else range(self.capacity - 1, 0, -1))

    def relay(self, levels) -> Iterator[tuple]:
        """Lay the open windows of some levels end to end and cut them at the capacity; what is left over is an open window again."""
        held, fill = [], 0
        for pieces in [self.take(level) for level in levels for _ in range(len(self.stock[level]))]:
            for doc, start, ids, total in pieces:
                while fill + len(ids) // 4 >= self.capacity:
                    cut = self.capacity - fill
                    yield from self.close([*held, (doc, start, ids[: 4 * cut], total)])
                    start, ids, held, fill = start + cut, ids[4 * cut :], [], 0
                if ids:
                    held.append((doc, start, ids, total))
                    fill += len(ids) // 4
        if held:
            self.keep(fill, held)

    def end(self) -> Iterator[tuple]:
        yield from self.relay(range(self.capacity - 1, 0, -1))
        held = next((self.take(level)[::-1] for level in range(self.capacity) if self.stock[level]), [])
        left = sum(len(ids) for _, _, ids, _ in held) // 4
        while left:
            room = 1 << (left.bit_length() - 1)
            left, pieces = left - room, []
            while room:
                doc, start, ids, total = held.pop()
                cut = min(room, len(ids) // 4)
                pieces.append((doc, start, ids[: 4 * cut], total))
                if len(ids) > 4 * cut:
                    held.append((doc, start + cut, ids[4 * cut :], total))
                room -= cut
            yield from self.close(pieces)


def pack_documents(docs: DataFrame, path: str, pattern: str, end_id: int, capacity: int = 2048, most_open: int = OPEN) -> DataFrame:
    """The pieces of all documents, each in its sequence: doc_id, start, length, ids (little-endian unsigned 32-bit integers), doc_tokens, sequence_id,
    offset.

    A document is the ids of its text (a null one is empty) and ``end_id``. Every id lies in one piece; offsets in a sequence are gapless from 0.
    A sequence has ``capacity`` ids, but for the last ones of a partition, whose lengths are powers of two. Repeated rows
    and null ids are packed like others, no rows give no rows, and columns other than doc_id and text are ignored. No shuffle: a task's result depends
    on its own rows only, so a lost one is repeated alone, with the same sequences.
    """

    def make(rows):
        ranks = rank_file(path, pattern)
        packer = Packer(capacity, TaskContext.get().partitionId() << 36, most_open)
        for key, value in rows:
            ids = ranks.ids(value)
            ids.append(end_id)
            yield from packer.put(key, little_endian(ids))
        yield from packer.end()

    return map_partition(docs.select("doc_id", text_or_empty().alias("t")), make, DDL)
