"""Sets of word shingles as 64-bit hashes, and the blocks of their parity sketches."""

from __future__ import annotations

import numpy as np

from hitframe.llm.common import per_worker

WORDS = 5
U = np.uint64
#: Odd multipliers of the hashes (fixed values).
BASE, STEP, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9


def _powers(n: int, base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[U(1)], np.full(n, U(base))]))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE ** 0`` to ``BASE ** n`` and their inverses; those up to 2**18 are kept by the worker."""
    make = lambda m: (_powers(m, BASE), _powers(m, pow(BASE, -1, 1 << 64)))
    if n > 1 << 18:
        return make(n)
    up, down = per_worker("powers", lambda: make(1 << 18))
    return up[: n + 1], down[: n + 1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads differences over all bits."""
    x = (x ^ (x >> U(30))) * U(MIX)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``WORDS`` words, A-Z in lower case; with fewer words, of the whole sequence.

    Words are separated by spaces, tabs and the characters up to carriage return. No words: an empty set. A word's
    hash is a polynomial of its bytes and its length; a shingle's is one of its words' hashes.
    """
    if not text:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer((text + " ").encode("utf-8", "surrogatepass"), np.uint8)
    raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    ends = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    starts = np.flatnonzero(np.concatenate([[True], blank[:-1]]) & ~blank)
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(raw))
    with np.errstate(over="ignore"):
        # a word's sum of byte * BASE**place, moved to the start of the text
        total = np.concatenate([[U(0)], np.cumsum((raw.astype(np.uint64) + U(1)) * up[: len(raw)])])
        word = (total[ends] - total[starts]) * down[starts]
        word = mixed(word + (ends - starts).astype(np.uint64))
        n = max(1, len(word) - WORDS + 1)
        code = np.zeros(n, np.uint64)
        for k in range(min(WORDS, len(word))):
            code = code * U(STEP) + word[k : k + n]
        if len(word) < WORDS:
            code = code + U(len(word))
        return np.unique(mixed(code))


def most_apart(size: int) -> int:
    """Largest symmetric difference of a set of ``size`` and one as large or larger that are similar (Jaccard 0.8 or more).

    With i in common, 100 i >= 80 (a + b - i) gives a + b - 2 i <= (a + b) / 9.
    """
    return (size + size * 5 // 4) // 9


def band_of(size: int) -> int:
    """Band k holds the sizes from 2**k to 2**(k + 1) - 1."""
    return size.bit_length() - 1


def block_count(band: int) -> int:
    """Blocks of a band's sketch: more than any pair that meets in the band can differ in, with room for empty blocks."""
    low = 1 << band
    widest = (2 * low - 1 + (2 * low - 1) * 5 // 4) // 9
    return max(widest + 1, int(0.6 * low) + 1)


def band_blocks(codes: np.ndarray, band: int, need: int | None = None) -> np.ndarray:
    """Keys of the first ``need`` (or of all) blocks of a set's parity sketch in a band, in an order that is the same for all sets.

    Every hash flips one bit of one block. Blocks hold so many bits that a block is kept as the XOR of its hashes: two
    sets have the same XOR where they have the same bits. Sets that differ in at most d hashes agree in all but d blocks.
    The order is that of the keys, and a key starts with the number of hashes: blocks of many come first, empty ones last.
    So two such sets have a key in common among their first d + 1.
    """
    blocks = block_count(band)
    at = ((codes >> U(32)) * U(blocks)) >> U(32)  # in ascending order, as the hashes are
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    parity = np.bitwise_xor.reduceat(mixed(codes ^ U(0x5851F42D4C957F2D)), first)
    many = np.minimum(np.diff(np.concatenate([first, [len(at)]])), 254).astype(np.uint64)
    with np.errstate(over="ignore"):
        keys = np.sort((mixed(parity ^ mixed(at[first] * U(2654435761) + U(band))) >> U(8)) | ((U(254) - many) << U(56)))
        if need is None or len(keys) < need:
            empty = np.setdiff1d(np.arange(blocks), at[first].astype(np.int64)).astype(np.uint64)
            keys = np.concatenate([keys, np.sort((mixed(empty * U(2654435761) + U(band + 64)) >> U(8)) | (U(255) << U(56)))])
    return keys[:need]


def bands_of(n: int) -> list[tuple[int, int]]:
    """(band, number of keys that the pigeonhole asks for) of a set's own band, and of the next smaller one if a similar set
    can be in it.

    Both sets of a pair take a key more than they can differ in: a larger set of the next band meets this one in its own band.
    """
    if not n:
        return []
    band = band_of(n)
    bands = [(band, most_apart(n) + 1)]
    if band and 5 * (2**band - 1) >= 4 * n:  # a set of the band below has at most 2**band - 1
        bands.append((band - 1, (n + 2**band - 1) // 9 + 1))
    return bands


def sketch_keys(codes: np.ndarray) -> np.ndarray:
    """The keys by which a set is joined at first."""
    keys = [band_blocks(codes, band, need) for band, need in bands_of(len(codes))]
    return np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)


def parity_sketch(codes: np.ndarray, bits: int) -> bytes:
    """``bits`` bits; each hash flips one. The Hamming distance of two sketches is at most the symmetric difference."""
    return np.packbits(np.bincount((codes & U(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def fingerprint(codes: np.ndarray) -> int:
    """A signed 64-bit number that tells sets apart: a hash of the XOR and the sum of the hashes."""
    with np.errstate(over="ignore"):
        both = np.array([np.bitwise_xor.reduce(codes), codes.sum(dtype=np.uint64)])
        return int(mixed(both[:1] + mixed(both[1:] * U(STEP)))[0].astype(np.int64))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """100 times the intersection is at least 80 times the union; an empty set is similar to nothing."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common > 0 and 100 * common >= 80 * (len(a) + len(b) - common)
