"""Importance resampling towards a target text set by hashed n-gram features.

Features are runs of one and two words. Each has a bucket (crc32 of its bytes); a bucket's gain is the logarithm of how much more common it
is in the target than in the source. A document's weight is the mean gain of its features, and documents are drawn without replacement by
weight plus Gumbel noise (the highest sums are the draw).

Tasks hold texts as byte arrays. The n-grams of a block of words are interned in an open-addressed table (``spans.InternTable``), so the
bucket is computed once for each distinct n-gram; slots carry bucket and count, and the slots of the occurrences gather the gains.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitframe.llm.common import arrow_schema
from hitframe.llm.spans import PAD, InternTable, lowered, runs, text_bytes
from hitframe.session import written

BUCKETS, SHARE, LEAST_WORDS, SEED = 10_000, 25, 20, 7
#: Bytes of text that are split into words at a time (a longer text is cut between words), and words whose n-grams share a table.
SLICE, BLOCK = 1 << 20, 1 << 16

#: Bytes of words: digits, lower-case letters and everything beyond ASCII.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def slices(texts: list[np.ndarray], size: int = SLICE) -> Iterator[tuple[list[int], list[np.ndarray], bool]]:
    """Rows and bytes of about ``size`` bytes of texts. A longer text comes in slices of its own, which are cut between words and begin
    with the last word of the slice before (``again``), so that no pair of words is lost."""
    rows, held, total = [], [], 0
    for row, raw in enumerate(texts):
        if len(raw) <= size:
            rows.append(row)
            held.append(raw)
            total += len(raw)
            if total >= size:
                yield rows, held, False
                rows, held, total = [], [], 0
            continue
        raw, at, end, again = lowered(raw), 0, 0, False
        member = WORD_BYTE[raw]
        while end < len(raw):
            end = max(end, at) + size
            while end < len(raw) and member[end - 1]:  # the cut stands behind a byte that is in no word
                gap = np.flatnonzero(~member[end : end + size])
                end += int(gap[0]) + 1 if len(gap) else size
            end = min(end, len(raw))
            starts, _ = runs(member[at:end], np.zeros(0, np.int64))
            if end < len(raw) and len(starts) == 1 and not starts[0]:
                continue  # one word so far: the slice goes on to the next
            yield [row], [raw[at:end]], again
            again = bool(len(starts))
            at = at + int(starts[-1]) if again else end
    if rows:
        yield rows, held, False


class Words:
    """Words of some texts in a buffer of their own: one space behind each, and ``PAD`` bytes at the end."""

    def __init__(self, texts: list[np.ndarray]):
        raw = lowered(np.concatenate([*texts, np.zeros(0, np.uint8)]))
        edges = np.cumsum([0, *map(len, texts)])
        member = WORD_BYTE[raw]
        starts, ends = runs(member, edges)
        self.lengths = ends - starts
        self.starts = np.cumsum(np.concatenate([[0], self.lengths + 1]))[:-1]
        self.buffer = np.full(int(self.lengths.sum()) + len(starts) + PAD, 0x20, np.uint8)
        inside = np.flatnonzero(member)
        self.buffer[np.arange(len(inside)) + np.repeat(np.arange(len(starts)), self.lengths)] = raw[inside]
        self.text = np.searchsorted(edges, starts, "right") - 1

    def blocks(self, again: bool, size: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Starts, lengths and texts of the n-grams that begin in ``size`` words at a time; with ``again`` the first word alone counts elsewhere."""
        n = len(self.starts)
        for a in range(0, n, size):
            one = np.arange(a, min(a + size, n))
            pair = one[one + 1 < n]
            pair = pair[self.text[pair] == self.text[pair + 1]]
            if again and not a:
                one = one[1:]
            lengths = np.concatenate([self.lengths[one], self.lengths[pair] + 1 + self.lengths[pair + 1]])
            yield np.concatenate([self.starts[one], self.starts[pair]]), lengths, np.concatenate([self.text[one], self.text[pair]])


def interned(words: Words, starts: np.ndarray, lengths: np.ndarray, buckets: int) -> tuple[InternTable, np.ndarray]:
    """The table of a block's n-grams and the bucket of every slot."""
    table = InternTable(words.buffer, starts, lengths)
    data, first = words.buffer.tobytes(), table.owner[table.used]
    bucket = np.zeros(len(table.owner), np.int64)
    bucket[table.used] = [zlib.crc32(data[a : a + n]) % buckets for a, n in zip(starts[first].tolist(), lengths[first].tolist())]
    return table, bucket


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: occurrences of features in all texts, one row for each bucket that has some. A task sends at most ``buckets`` rows."""
    schema = arrow_schema("bucket int, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, held, again in slices(text_bytes(batch.column(0))):
                words = Words(held)
                for starts, lengths, _ in words.blocks(again):
                    table, bucket = interned(words, starts, lengths, buckets)
                    np.add.at(total, bucket[table.used], table.counts[table.used])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], schema=schema)

    counted = docs.select(text).mapInArrow(run, "bucket int, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln(share in the target / share in the source)) of every bucket, each bucket with one occurrence more.

    Both tables have at most ``buckets`` rows, whatever the texts, and are collected.
    """
    counts = []
    for table in (source, target):
        own = np.zeros(buckets, np.int64)
        for row in table.collect():
            own[row["bucket"]] = row["n"]
        counts.append(own)
    (s, t), total_s, total_t = counts, int(counts[0].sum()), int(counts[1].sum())
    ratio = lambda a, b: (float(a) + 1.0) * (total_s + float(buckets)) / ((float(b) + 1.0) * (total_t + float(buckets)))
    return np.array([math.floor(1000.0 * math.log(ratio(a, b))) for a, b in zip(t.tolist(), s.tolist())], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_words, n_features and weight (floored mean gain of the features; 0 without any) of every document."""
    ddl = f"{id_column} long, n_words long, n_features long, weight long"
    schema, buckets = arrow_schema(ddl), len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_features, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for rows, held, again in slices(text_bytes(batch.column(1))):
                words, rows = Words(held), np.array(rows)
                n_words += np.bincount(rows[words.text], minlength=batch.num_rows)
                if again:
                    n_words[rows[0]] -= 1
                for starts, lengths, text_of in words.blocks(again):
                    table, bucket = interned(words, starts, lengths, buckets)
                    np.add.at(total, rows[text_of], gain[bucket][table.slots])
                    n_features += np.bincount(rows[text_of], minlength=batch.num_rows)
            weight = np.where(n_features > 0, total // np.maximum(n_features, 1), 0)
            ids = batch.column(0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in (n_words, n_features, weight))], schema=schema)

    return docs.select(F.col(id_column).cast("long").alias(id_column), text).mapInArrow(run, ddl)


def gumbel(id_column: str, seed: int) -> Column:
    """floor(1000 times a Gumbel variate), the same for an id always; a null id counts as the empty text."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def drawn(scored: DataFrame, eligible: Column, share: int, id_column: str = "doc_id") -> DataFrame:
    """Adds ``rank`` (1 for the highest score, ties to the smaller id) to the highest ``share`` percent of the eligible rows of a written table.

    Scores are whole numbers from a bounded range, so the number of rows above each is a small table, and rows are ordered only among
    those of equal score.
    """
    rows = scored.withColumn("__in", eligible)
    levels = rows.where("__in").groupBy("score").agg(F.count("*").alias("__n"))
    down = Window.orderBy(F.desc("score"))
    total = F.sum("__n").over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    above = levels.select("score", (F.sum("__n").over(down) - F.col("__n")).alias("__above"), F.floor(share * total / 100).alias("__limit"))
    reached = above.where("__above < __limit").withColumn("__in", F.lit(True))
    order = Window.partitionBy("score").orderBy(F.col(id_column).asc_nulls_first())
    some = rows.where("__in").join(reached.drop("__in"), "score").withColumn("__rank", F.col("__above") + F.row_number().over(order))
    ranked = some.withColumn("rank", F.when(F.col("__rank") <= F.col("__limit"), F.col("__rank"))).select(*scored.columns, "rank")
    rest = rows.join(reached.select("score", "__in"), ["score", "__in"], "left_anti")
    return ranked.unionByName(rest.select(*scored.columns, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight, score, rank (null: not drawn).

    Of the documents with at least ``least_words`` words ``share`` percent (rounded down) are drawn, those with the highest scores. Null and
    empty texts have no features and weight 0; null ids come first among ties; repeated rows each get a row, and count each; no documents give no rows, no
    target texts give all buckets the same count there. Columns of ``docs`` other than doc_id and text, and of ``target`` other than text, are ignored.
    """
    gain = gains(bucket_counts(docs, buckets=buckets), bucket_counts(target, buckets=buckets), buckets)
    scored = weights(docs, gain).withColumn("score", F.col("weight") + gumbel("doc_id", seed))
    return drawn(written(scored, "weights"), F.col("n_words") >= least_words, share)
