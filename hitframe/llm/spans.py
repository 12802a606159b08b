"""Words as spans of a byte array, hashed and interned by numpy without a Python object for each."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
#: Primes of the 64-bit xxHash (fixed values).
P1, P2, P3, P4, P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
#: Bytes behind the last word of a buffer, so that 8 bytes can be read from any place.
PAD = 16
#: Bits of a word's first k bytes.
LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def text_bytes(column: pa.Array) -> list[np.ndarray]:
    """The UTF-8 bytes of every text of an Arrow column, without copies; a null is empty."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    gone = column.is_null().to_numpy(zero_copy_only=False)
    return [data[:0] if g else data[a:b] for a, b, g in zip(offsets[:-1].tolist(), offsets[1:].tolist(), gone.tolist())]


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes as they are."""
    return np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)


def runs(member: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values; ``edges`` (ascending places) end a run too."""
    before = np.concatenate([[False], member[:-1]])
    before[edges[edges < len(member)]] = False
    after = np.concatenate([member[1:], [False]])
    last = edges[(edges > 0) & (edges <= len(member))] - 1
    after[last] = False
    return np.flatnonzero(member & ~before), np.flatnonzero(member & ~after) + 1


def eights(buffer: np.ndarray) -> np.ndarray:
    """Element i: the 8 bytes from place i as a little-endian number. ``buffer`` ends with ``PAD`` unused bytes."""
    return np.ndarray((len(buffer) - 7,), "<u8", buffer, strides=(1,))


def _rotl(x: np.ndarray, k: int) -> np.ndarray:
    return (x << U(k)) | (x >> U(64 - k))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * U(P2), 31) * U(P1)


def xxhash64(buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 0) -> np.ndarray:
    """xxHash64 of the bytes of every span, as the xxhash library gives it; steps run over all spans that are long enough."""
    words = eights(buffer)
    with np.errstate(over="ignore"):
        h = np.full(len(starts), (seed + P5) & (2**64 - 1), np.uint64)
        at, end = starts.astype(np.int64), starts + lengths
        if len(wide := np.flatnonzero(lengths >= 32)):
            acc = [np.full(len(wide), (seed + p) & (2**64 - 1), np.uint64) for p in (P1 + P2, P2, 0, -P1)]
            go = np.arange(len(wide))
            while len(go):
                place = at[wide[go]]
                for lane in range(4):
                    acc[lane][go] = _round(acc[lane][go], words[place + 8 * lane])
                at[wide[go]] += 32
                go = go[at[wide[go]] + 32 <= end[wide[go]]]
            merged = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
            for lane in acc:
                merged = (merged ^ _round(np.zeros_like(lane), lane)) * U(P1) + U(P4)
            h[wide] = merged
        h += lengths.astype(np.uint64)
        for width in (8, 4, 1):
            go = np.flatnonzero(end - at >= width)
            while len(go):
                lane = words[at[go]] & LOW_BYTES[width]
                if width == 8:
                    h[go] = _rotl(h[go] ^ _round(np.zeros_like(lane), lane), 27) * U(P1) + U(P4)
                elif width == 4:
                    h[go] = _rotl(h[go] ^ (lane * U(P1)), 23) * U(P2) + U(P3)
                else:
                    h[go] = _rotl(h[go] ^ (lane * U(P5)), 11) * U(P1)
                at[go] += width
                go = go[end[go] - at[go] >= width]
        h = (h ^ (h >> U(33))) * U(P2)
        h = (h ^ (h >> U(29))) * U(P3)
        return h ^ (h >> U(32))


def same_bytes(buffer: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the spans of ``lengths`` from places ``a`` and ``b`` hold the same bytes."""
    words, same = eights(buffer), np.ones(len(a), bool)
    go, done = np.arange(len(a)), 0
    while len(go):
        mask = LOW_BYTES[np.minimum(lengths[go] - done, 8)]
        same[go] = ((words[a[go] + done] ^ words[b[go] + done]) & mask) == 0
        done += 8
        go = go[same[go] & (lengths[go] > done)]
    return same


class InternTable:
    """Open-addressed table of the distinct spans of a block.

    A slot is found by the xxHash64 of a span and linear probing, and holds the first span that took it; a span joins a slot only where hash, length
    and bytes are equal. ``slots`` names the slot of every span, in the order of spans; ``owner`` the first span of every slot
    (-1: free), ``counts`` the number of its spans.
    """

    def __init__(self, buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray | None = None):
        n = len(starts)
        size = 1 << max(4, (2 * n - 1).bit_length())
        self.hashes = xxhash64(buffer, starts, lengths) if hashes is None else hashes
        self.owner = np.full(size, -1, np.int64)
        self.slots = np.full(n, -1, np.int64)
        places, rest = (self.hashes & U(size - 1)).astype(np.int64), np.arange(n)
        while len(rest):
            at = places[rest]
            free = self.owner[at] < 0
            self.owner[at[free][::-1]] = rest[free][::-1]  # of several spans for a free slot the first takes it
            holder = self.owner[at]
            own = holder == rest
            like = ~own & (self.hashes[holder] == self.hashes[rest]) & (lengths[holder] == lengths[rest])
            maybe = np.flatnonzero(like)
            like[maybe] = same_bytes(buffer, starts[holder[maybe]], starts[rest[maybe]], lengths[rest[maybe]])
            settled = own | like
            self.slots[rest[settled]] = at[settled]
            rest = rest[~settled]
            places[rest] = (places[rest] + 1) & (size - 1)
        self.counts = np.bincount(self.slots, minlength=size)
        self.used = np.flatnonzero(self.owner >= 0)
