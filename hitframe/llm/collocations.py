"""Collocations: phrases that are common and whose parts belong together, counted by FM-indexes over word ids.

Texts of a language are cut into shards. A shard's index is the Burrows-Wheeler transform of its word ids, with a separator of its own behind every piece
(text between two stops), and the places where each word's rows begin. Rows that begin with one phrase are an interval. An interval is
extended to the left by a word through the transform, to the right by splitting it, and its length is the phrase's count in the shard;
both sides' intervals are at hand at every depth, so a phrase is entered only where its first and its last words are alive.

Counts of words and pairs are first summed over the shards by short hashes, which can only keep too much; shards then enumerate the phrases
that have nothing but frequent pairs, and their counts are summed by long hashes. Counts travel packed, many phrases to a row; only frequent
phrases are spelled, each by one of its shards. Scores come from joins of frequent phrases with their parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hitframe.llm.common import LARGE_ROWS, arrow_schema, map_partition, small_batches
from hitframe.llm.shingles import STEP, mixed
from hitframe.llm.spans import PAD, InternTable, lowered, runs, text_bytes
from hitframe.session import written

DEPTH, LEAST, TOP = 5, 100, 2000
#: Bytes of text from which a language's texts become a shard, bytes that a task holds for all languages, and parts into which a language's rows are dealt.
SHARD_BYTES, HELD_BYTES, PARTS = 3 << 20, 12 << 20, 64
#: Keys of words and pairs that one group of a sum over the shards has at most, on average.
BUCKET_KEYS = 1 << 21
#: Shards, and buckets of a sum, that a task gets on average: what it sorts does not grow with the texts.
TASK_SHARDS, TASK_BUCKETS = 4, 2
UNKNOWN = "und"

#: Bytes that end a piece, and bytes between words of a piece (fixed values).
STOP, BLANK = np.zeros(256, bool), np.zeros(256, bool)
STOP[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
BLANK[[0x20, 0x09]] = True

SHARD_DDL = "shard long, lang string, n_words long, words binary, bwt binary"


def packed(data: bytes) -> bytes:
    """By zstandard, behind the length: a shard's row passes through the JVM several times."""
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def unpacked(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def suffix_array(tokens: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of word ids in their order. A 0 is a separator; each is a symbol of its own, smaller than any word, so suffixes differ
    at their piece's end at the latest.

    Prefix doubling: suffixes are sorted by the rank of twice as many words each time, those alone with their rank no more.
    """
    n, gaps = len(tokens), tokens == 0
    rank = np.where(gaps, np.cumsum(gaps) - 1, tokens.astype(np.int64) + n)
    order = np.argsort(rank, kind="stable")
    step, rest = 0, np.arange(n)  # places of ``order`` whose rank is not theirs alone
    while len(rest):
        own = order[rest]
        if step:
            key = (rank[own] << 32) | rank[np.minimum(own + step, n - 1)]
            sort = np.argsort(key, kind="stable")
            own, key = own[sort], key[sort]
            order[rest] = own
        else:
            key = rank[own]
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        rank[own] = rest[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]  # a group's rank is its first place
        alone = fresh & np.concatenate([fresh[1:], [True]])
        rest, step = rest[~alone], max(1, 2 * step)
    return order


def index_of(texts: list[np.ndarray]) -> tuple[int, list[bytes], np.ndarray]:
    """Number of words, the distinct words (ids from 1), and the transform of the texts' bytes."""
    gap = np.frombuffer(b"\n", np.uint8)
    raw = lowered(np.concatenate([part for text in texts for part in (text, gap)] + [np.zeros(PAD, np.uint8)]))
    stop = STOP[raw]
    member = ~(stop | BLANK[raw])
    member[-PAD:] = False
    starts, ends = runs(member, np.zeros(0, np.int64))
    if not len(starts):
        return 0, [], np.zeros(0, np.int32)
    table = InternTable(raw, starts, ends - starts)
    number = np.zeros(len(table.owner), np.int32)
    number[table.used] = np.arange(1, len(table.used) + 1)
    first = table.owner[table.used]
    data = raw.tobytes()
    words = [data[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
    stops = np.cumsum(stop)[starts]
    piece = np.cumsum(np.concatenate([[0], stops[1:] != stops[:-1]]))
    tokens = np.zeros(len(starts) + int(piece[-1]) + 1, np.int32)
    tokens[np.arange(len(starts)) + piece] = number[table.slots]
    return len(starts), words, tokens[suffix_array(tokens) - 1]


def chunks(raw: np.ndarray, size: int = SHARD_BYTES) -> Iterator[np.ndarray]:
    """A text in parts of at most ``size`` bytes, cut at stops; a piece that is longer stays whole."""
    at = 0
    while len(raw) - at > size:
        stops = np.flatnonzero(STOP[raw[at : at + size]])
        if not len(stops):
            later = next((k for k in range(at + size, len(raw), size) if STOP[raw[k : k + size]].any()), None)
            if later is None:
                break
            stops = np.flatnonzero(STOP[raw[later : later + size]])[:1] + (later - at)
        cut = at + int(stops[-1]) + 1
        yield raw[at:cut]
        at = cut
    yield raw[at:]


def shards(docs: DataFrame, size: int = SHARD_BYTES, held_bytes: int = HELD_BYTES) -> DataFrame:
    """The index of every shard: shard, lang, n_words, words (in the order of their ids, one space between), bwt (32-bit ids), both
    ``packed``. Write it before use: a shard's number and rows are those of one evaluation."""
    schema = arrow_schema(SHARD_DDL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        sizes: dict[str, int] = {}
        number = TaskContext.get().partitionId() << 32

        def close(lang):
            nonlocal number
            n, words, bwt = index_of(held.pop(lang))
            del sizes[lang]
            number += 1
            row = (number, lang, n, packed(b" ".join(words)), packed(bwt.astype("<i4").tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, schema.types)], schema=schema)

        for batch in batches:
            for lang, raw in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                for part in chunks(raw, size):
                    held.setdefault(lang, []).append(part.copy())
                    sizes[lang] = sizes.get(lang, 0) + len(part) + 1
                    if sizes[lang] >= size:
                        yield close(lang)
                if sum(sizes.values()) > held_bytes:
                    yield from map(close, list(held))
        yield from map(close, list(held))

    return docs.select(F.coalesce(F.col("lang"), F.lit(UNKNOWN)).alias("lang"), "text").mapInArrow(run, SHARD_DDL)


class Intervals:
    """Intervals of a shard's rows by phrase, one word deeper with each ``deeper``.

    ``first`` names the interval of every row by its first row (-1: the phrase reaches over the end of a piece, or is not alive).
    """

    def __init__(self, bwt: bytes):
        symbols = np.frombuffer(bwt, "<i4")
        counts = np.bincount(symbols, minlength=1)
        #: The row of a row's suffix without its first word: the inverse of the step to the left, C[word] + occurrences so far.
        self.next = np.argsort(symbols, kind="stable")
        self.word = np.repeat(np.arange(len(counts)), counts)
        starts = np.cumsum(counts) - counts
        self.first = np.where(self.word > 0, starts[self.word], -1)
        self.by_word = self.first

    def deeper(self, alive: np.ndarray | None = None) -> None:
        """From phrases of d words to those of d + 1, whose first and last d words must be among ``alive`` (by first row; None: all)."""
        tail = np.where(self.word > 0, self.first[self.next], -1)
        ok = (tail >= 0) & (self.first >= 0)
        if alive is not None:
            ok &= alive[self.first] & alive[tail]
        rows = np.arange(len(tail))
        fresh = np.ones(len(tail), bool)
        fresh[1:] = (tail[1:] != tail[:-1]) | (self.by_word[1:] != self.by_word[:-1])
        self.first = np.where(ok, np.maximum.accumulate(np.where(fresh, rows, 0)), -1)

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """First rows of the intervals, and their lengths."""
        rows = np.flatnonzero(self.first >= 0)
        firsts = self.first[rows]
        at = np.flatnonzero(np.concatenate([[True], firsts[1:] != firsts[:-1]])) if len(rows) else rows
        return firsts[at], np.diff(np.concatenate([at, [len(rows)]]))

    def phrase(self, firsts: np.ndarray, depth: int) -> list[np.ndarray]:
        """The words (ids) at every place of the phrases that begin at ``firsts``."""
        out = []
        for _ in range(depth):
            out.append(self.word[firsts])
            firsts = self.next[firsts]
        return out


def word_hashes(lang: str, words: list[bytes], seed: int) -> np.ndarray:
    """A hash of every word of a language; that of id 0 is not used."""
    seed = xxhash.xxh32_intdigest(lang.encode("utf-8", "surrogatepass"), seed)
    return np.array([0, *(xxhash.xxh64_intdigest(w, seed) for w in words)], np.uint64)


class Listing:
    """Phrases of a shard in the order of their bucket and their keys, a 64-bit and a 32-bit hash.

    Without ``alive`` these are all words and pairs; with it (rows of bucket and places in that list) the words and pairs named, and all longer
    phrases whose pairs are all named. The same arguments give the same list.
    """

    def __init__(self, index: tuple, buckets: int, alive: list[tuple] | None = None, depth: int = 2):
        _, self.lang, words, bwt = index
        self.words = unpacked(words).split(b" ")
        self.intervals, live = Intervals(unpacked(bwt)), {}
        if alive is not None:
            short = Listing(index, buckets)
            for d in (1, 2):
                live[d] = np.zeros(len(self.intervals.word), bool)
            for bucket, which in alive:
                at = short.places(bucket, which)
                for d in (1, 2):
                    live[d][short.first[at[short.depth[at] == d]]] = True
        hashes, found = [word_hashes(self.lang, self.words, seed) for seed in (0, 1)], []
        for d in range(1, depth + 1):
            if d > 1:
                self.intervals.deeper(live.get(d - 1))
            firsts, counts = self.intervals.counted()
            if d in live:
                keep = live[d][firsts]
                firsts, counts = firsts[keep], counts[keep]
            keys = [np.zeros(len(firsts), np.uint64) for _ in hashes]
            with np.errstate(over="ignore"):
                for ids in self.intervals.phrase(firsts, d):
                    keys = [mixed(key * np.uint64(STEP) + own[ids]) for key, own in zip(keys, hashes)]
            found.append((*keys, counts, np.full(len(firsts), d), firsts))
        key, check, *rest = (np.concatenate(c) for c in zip(*found))
        check = (check >> np.uint64(32)).astype("<u4")
        bucket = ((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        order = np.lexsort((check, key, bucket)) if alive is not None else np.argsort((bucket << np.uint64(32)) | check, kind="stable")
        self.bucket, self.key, self.check, self.count, self.depth, self.first = (c[order] for c in (bucket.astype(np.int64), key, check, *rest))

    def places(self, bucket: int, which: bytes) -> np.ndarray:
        return np.searchsorted(self.bucket, bucket) + np.frombuffer(which, "<i4")

    def rows(self, shard: int, with_keys: bool) -> Iterator[tuple]:
        edges = np.flatnonzero(np.concatenate([[True], self.bucket[1:] != self.bucket[:-1], [True]])) if len(self.bucket) else [0]
        for a, b in zip(edges[:-1], edges[1:]):
            keys = self.key[a:b].astype("<u8").tobytes() if with_keys else None
            yield int(self.bucket[a]), shard, keys, self.check[a:b].tobytes(), self.count[a:b].astype("<u4").tobytes()

    def phrases(self, at: np.ndarray) -> list[bytes]:
        names, out = [b"", *self.words], []
        for d, first in zip(self.depth[at].tolist(), self.first[at].tolist()):
            out.append(b" ".join(names[int(ids[0])] for ids in self.intervals.phrase(np.array([first]), d)))
        return out


PACKED_DDL = "bucket long, shard long, keys binary, checks binary, counts binary"
ALIVE_DDL = "shard long, bucket long, which binary, f binary"


def short_counts(indexes: DataFrame, buckets: int) -> DataFrame:
    """Words and pairs of every shard, with 32-bit keys: a row for each bucket that has some."""

    def make(rows):
        for index in rows:
            if unpacked(index[2]):
                yield from Listing(index, buckets).rows(index[0], False)

    return map_partition(indexes.select("shard", "lang", "words", "bwt"), make, PACKED_DDL)


def summed(counts: DataFrame, buckets: int, least: int, one_of_each: bool) -> DataFrame:
    """shard, bucket, which: the places, in a shard's list of a bucket, of the keys whose counts in all shards add up to ``least`` (f: the sums).

    With ``one_of_each`` every key is named in one of its shards only.
    """
    schema = arrow_schema(ALIVE_DDL)

    def run(rows: pa.Table) -> pa.Table:
        parts = [np.frombuffer(c, "<u4") for c in rows["checks"].to_pylist()]
        edges = np.cumsum([0, *map(len, parts)])
        n = np.concatenate([np.frombuffer(c, "<u4") for c in rows["counts"].to_pylist()]).astype(np.int64)
        columns = [np.concatenate(parts)]
        if rows["keys"].null_count == 0:
            columns.append(np.concatenate([np.frombuffer(k, "<u8") for k in rows["keys"].to_pylist()]))
        order = np.lexsort(columns) if len(columns) > 1 else np.argsort(columns[0], kind="stable")
        fresh = np.ones(len(order), bool)
        fresh[1:] = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
        start, group = np.flatnonzero(fresh), np.cumsum(fresh) - 1
        total = np.add.reduceat(n[order], start)
        live = (total >= least)[group]
        if one_of_each:
            size = np.diff(np.concatenate([start, [len(order)]]))
            chosen = start + columns[0][order[start]] % size  # a member by the key, so that no shard gets most of them
            live &= np.isin(np.arange(len(order)), chosen)
        sums = np.zeros(len(order), np.int64)
        sums[order] = np.where(live, total[group], 0)
        which = [np.flatnonzero(sums[a:b]).astype("<i4") for a, b in zip(edges, edges[1:])]
        f = [sums[a:b][w].astype("<i8").tobytes() for a, b, w in zip(edges, edges[1:], which)]
        which = [w.tobytes() for w in which]
        return pa.Table.from_arrays([rows["shard"], rows["bucket"], pa.array(which, pa.binary()), pa.array(f, pa.binary())], schema=schema)

    dealt = counts.repartition(1 + buckets // TASK_BUCKETS, "bucket")
    return dealt.groupBy("bucket").applyInArrow(run, ALIVE_DDL).where(F.length("which") > 0)


def in_shards(indexes: DataFrame, named: DataFrame, tasks: int, make, ddl: str) -> DataFrame:
    """Rows of ``make(index, rows of named)`` for every shard that ``named`` has rows of."""
    schema = arrow_schema(ddl)

    def run(index: pa.Table, rows: pa.Table) -> pa.Table:
        if not index.num_rows or not rows.num_rows:
            return schema.empty_table()
        found = list(make(tuple(index[c][0].as_py() for c in ("shard", "lang", "words", "bwt")), rows.to_pylist()))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), schema.types)], schema=schema) if found else schema.empty_table()

    dealt = indexes.select("shard", "lang", "words", "bwt").repartition(tasks, "shard")
    return dealt.groupBy("shard").cogroup(named.repartition(tasks, "shard").groupBy("shard")).applyInArrow(run, ddl)


def long_counts(indexes: DataFrame, alive: DataFrame, tasks: int, buckets: int, depth: int) -> DataFrame:
    """The words and pairs that are ``alive`` in every shard, and all longer phrases of such pairs, with 96-bit keys."""

    def make(index, rows):
        return Listing(index, buckets, [(r["bucket"], r["which"]) for r in rows], depth).rows(index[0], True)

    return in_shards(indexes, alive, tasks, make, PACKED_DDL)


def spelled(indexes: DataFrame, alive: DataFrame, found: DataFrame, tasks: int, buckets: int, depth: int) -> DataFrame:
    """lang, phrase, f of the keys that ``found`` names, by the shards that hold them."""

    def make(index, rows):
        listing = Listing(index, buckets, [(r["bucket"], r["which"]) for r in rows if r["f"] is None], depth)
        for r in rows:
            if r["f"] is not None:
                phrases = listing.phrases(listing.places(r["bucket"], r["which"]))
                for phrase, f in zip(phrases, np.frombuffer(r["f"], "<i8").tolist()):
                    yield listing.lang, phrase.decode("utf-8"), f

    both = alive.withColumn("f", F.lit(None).cast("binary")).unionByName(found)
    return in_shards(indexes, both, tasks, make, "lang string, phrase string, f long")


def frequent(indexes: DataFrame, least: int = LEAST, depth: int = DEPTH) -> DataFrame:
    """lang, phrase, f of all phrases of 1 to ``depth`` words that are found ``least`` times or more; ``indexes`` is a written table of ``shards``.

    The number of buckets grows with the words, so that a bucket has at most about ``BUCKET_KEYS`` keys of words and pairs; the numbers of tasks grow with
    buckets and shards, whatever the number of shuffle partitions. Phrases are told apart by 96-bit hashes of their words.
    """
    words, n = indexes.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.count("*")).first()
    buckets, tasks = 1 + 2 * words // BUCKET_KEYS, 1 + n // TASK_SHARDS
    alive = written(summed(short_counts(indexes, buckets), buckets, least, False).drop("f"), "alive", **LARGE_ROWS)
    found = written(summed(long_counts(indexes, alive, tasks, buckets, depth), buckets, least, True), "found", **LARGE_ROWS)
    return written(spelled(indexes, alive, found, tasks, buckets, depth), "phrases")


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of every phrase of two words or more: the cut of the lowest score, of equal ones the first.

    ``phrases`` is lang, phrase, f, with all parts of its phrases; ``totals`` is lang, n. Products are decimals of 38 digits.
    """
    split = phrases.select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w")).where(F.size("w") > 1)
    cuts = split.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    part = lambda start, length: F.concat_ws(" ", F.slice("w", start, length))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.size("w")).alias("right"))
    for side, count in (("left", "l"), ("right", "r")):
        cuts = cuts.join(phrases.select("lang", F.col("phrase").alias(side), F.col("f").alias(count)), ["lang", side])
    dealt = totals.select("lang", "n", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    cuts = cuts.withColumn("part", F.pmod(F.hash("phrase"), F.lit(PARTS))).join(dealt, ["lang", "part"])
    long = lambda c: f"CAST({c} AS DECIMAL(18, 0))"
    score = F.expr(f"(CAST(1000 AS DECIMAL(4, 0)) * {long('a')} * {long('n')}) div ({long('l')} * {long('r')})")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("c"))
    return best.select("lang", "phrase", "c.a", "c.l", "c.r", "c.n", "c.score")


def whole(phrases: DataFrame) -> DataFrame:
    """Those of ``phrases`` (lang, phrase, f) of two words or more that are not part of a longer one found as often.

    A phrase that is part of such a longer one is also the beginning or the end of one with one word more, found as often.
    """
    w = phrases.select("lang", "f", "phrase", F.split("phrase", " ").alias("w")).where(F.size("w") > 1)
    ends = F.array(F.slice("w", 1, F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1))
    inner = w.where(F.size("w") > 2).select("lang", "f", F.explode(ends).alias("p")).select("lang", "f", F.concat_ws(" ", "p").alias("phrase"))
    return w.select("lang", "phrase").join(w.join(inner.distinct(), ["lang", "phrase", "f"], "left_semi").select("lang", "phrase"), ["lang", "phrase"], "left_anti")


def collocations(docs: DataFrame, least: int = LEAST, depth: int = DEPTH, size: int = SHARD_BYTES) -> DataFrame:
    """All collocations: lang, phrase, a, l, r, n, score.

    Everything is per ``lang`` (null: ``und``). A phrase is 2 to ``depth`` words in a row without a stop between them, found at least ``least``
    times (a) and not part of a longer phrase found as often; n is the number of words, l and r are the counts of the two parts. Null and empty texts have no words; repeated rows
    count each; no documents give no rows. Columns other than lang and text are ignored.
    """
    small_batches(docs.sparkSession)
    indexes = written(shards(docs, size), "shards", **LARGE_ROWS)  # a row is megabytes, and is read by itself
    phrases = frequent(indexes, least, depth)
    totals = indexes.groupBy("lang").agg(F.sum("n_words").alias("n"))
    return scored(phrases, totals).join(whole(phrases), ["lang", "phrase"], "left_semi")


def best(found: DataFrame, top: int = TOP) -> DataFrame:
    """Adds ``rank`` to the ``top`` highest scores of every language (ties: higher a, then the phrase in the order of its bytes); others go.

    A language's rows are ranked in parts first, so only the best of each part meet in one task.
    """
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = found.withColumn("__part", F.pmod(F.hash("phrase"), F.lit(PARTS)))
    ahead = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "__part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = ahead.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.drop("__part")
