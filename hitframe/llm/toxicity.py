"""Toxicity: subword-bag embeddings averaged over a window of words into a linear softmax, trained jointly in numpy.

A word is the bag of its byte n-grams, so a misspelling shares most vectors with the word it stands for. A window's vector
is the mean over its words; a document's score is that of its most toxic window, so a long text dilutes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitframe.llm.common import map_partition, text_or_empty

#: n-gram lengths (a word's edges count as one byte each), hash cells of their vectors, length of a vector, words of a window.
LENGTHS, CELLS, DIM, WINDOW = (3, 4, 5), 1 << 16, 8, 4
#: Bounds of the training sample, for each label: documents and characters.
ROWS, CHARS = 3000, 12_000_000
#: Bytes of a text that are looked at together.
STEP = 1 << 18


def words_of(data: bytes) -> np.ndarray:
    """ASCII letters in lower case, digits and bytes above 127; everything else is one edge between two words."""
    table = np.full(256, 32, np.uint8)
    table[48:58] = np.arange(48, 58)
    table[97:123] = table[65:91] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    raw = table[np.frombuffer(b" " + data + b" ", np.uint8)]
    keep = np.ones(len(raw), bool)
    keep[1:] = (raw[1:] != 32) | (raw[:-1] != 32)
    return raw[keep]


def grams(raw: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, int]:
    """(word numbers, cells) of all n-grams inside words, and the number of words."""
    edge = raw == 32
    number = np.cumsum(edge) - 1
    words, codes = [], []
    wide = raw.astype(np.uint32)
    code = np.zeros(len(raw), np.uint32)
    for n in range(1, LENGTHS[-1] + 1):  # a gram's code goes on from the code of its first n - 1 bytes
        m = len(raw) - n + 1
        if m <= 0:
            break
        code = (code[:m] ^ wide[n - 1 :]) * np.uint32(0x01000193)
        if n not in LENGTHS:
            continue
        fits = number[n - 2 : n - 2 + m] == number[:m]  # an edge may only be the first or the last byte
        mixed = code[fits]
        mixed ^= mixed >> np.uint32(15)
        words.append(number[:m][fits])
        codes.append(((mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(11)) % np.uint32(cells))
    n_words = int(edge.sum()) - 1
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32), max(0, n_words)
    return np.concatenate(words), np.concatenate(codes), max(0, n_words)


@dataclass(frozen=True)
class ToxicityModel:
    """What scoring needs of the embeddings and the softmax: each cell's vector times the weights, and the bias."""

    cell: np.ndarray
    bias: float
    window: int = WINDOW

    def score(self, text: str) -> float:
        """Probability that the most toxic window of the whole text is toxic; without words, that of an empty window."""
        data, best = text.encode("utf-8", "replace"), -np.inf
        tail = np.zeros(0)
        for at in range(0, len(data), STEP):
            end = at + STEP
            while end < len(data) and data[end] > 32 and end < at + 2 * STEP:
                end += 1  # not inside a word
            begin = at
            while at and begin < len(data) and data[begin] > 32 and begin < at + STEP:
                begin += 1
            word, cell, n = grams(words_of(data[begin:end]), len(self.cell))
            if n:
                sums = np.bincount(word, self.cell[cell], n)[:n] / np.maximum(np.bincount(word, minlength=n)[:n], 1)
                both = np.concatenate([tail, sums])
                best = max(best, window_means(both, self.window).max())
                tail = both[-(self.window - 1) :]
        if best == -np.inf:
            best = 0.0
        return float(1 / (1 + np.exp(-(best + self.bias))))


def window_means(values: np.ndarray, window: int) -> np.ndarray:
    """Means of all runs of ``window`` values (of all values, if there are fewer)."""
    size = min(window, len(values))
    total = np.concatenate([[0.0], np.cumsum(values)])
    return (total[size:] - total[:-size]) / size


def train(
    texts: list[str], labels: list[int], weights: list[float], cells: int = CELLS, dim: int = DIM,
    window: int = WINDOW, epochs: int = 30, rate: float = 0.5, decay: float = 1e-6, seed: int = 0,
) -> ToxicityModel:
    """Embeddings and softmax weights by AdaGrad on the log loss of each document's most toxic window.

    Two classes make the softmax a logistic function of the difference of their weights. Without texts of both labels, all
    scores are the share of label 1 (0.5 without any).
    """
    y, importance = np.array(labels, float), np.array(weights, float)
    prior = float((y * importance).sum() / importance.sum()) if len(y) else 0.5
    if not len(y) or prior in (0.0, 1.0):
        edge = min(max(prior, 1e-6), 1 - 1e-6)
        return ToxicityModel(np.zeros(cells), float(np.log(edge / (1 - edge))), window)
    known: dict[bytes, int] = {}
    docs = [np.array([known.setdefault(w, len(known)) for w in words_of(t.encode("utf-8", "replace")).tobytes().split()], np.int64) for t in texts]
    word, cell, n_words = grams(np.frombuffer(b" " + b" ".join(known) + b" ", np.uint8), cells)
    order = np.argsort(word, kind="stable")
    cell = cell[order]
    edges = np.searchsorted(word[order], np.arange(len(known) + 1))
    per_word = np.maximum(np.diff(edges), 1)
    owner = np.repeat(np.arange(len(known)), np.diff(edges))
    filled = [i for i, d in enumerate(docs) if len(d)]
    rng = np.random.default_rng(seed)
    vectors, out, bias = rng.normal(0, 1 / dim, (cells, dim)), rng.normal(0, 1, dim), float(np.log(prior / (1 - prior)))
    g_vectors, g_out, g_bias = np.full((cells, dim), 1e-6), np.full(dim, 1e-6), 1e-6
    importance = importance / importance.mean()
    for epoch in range(epochs):
        rng.shuffle(filled)
        for part in np.array_split(np.array(filled), max(1, min(16, len(filled) // 64))):
            used = np.unique(np.concatenate([docs[i] for i in part]))
            spot = np.full(len(known), -1)
            spot[used] = np.arange(len(used))
            lengths = edges[used + 1] - edges[used]
            flat = np.concatenate([[0], np.cumsum(lengths)])
            at = np.arange(flat[-1]) - np.repeat(flat[:-1], lengths) + np.repeat(edges[used], lengths)
            value = vectors @ out
            projected = np.bincount(np.repeat(np.arange(len(used)), lengths), value[cell[at]], len(used)) / per_word[used]
            chosen, slope, sizes = [], [], []
            for i in part:
                means = window_means(projected[spot[docs[i]]], window)
                best = int(means.argmax())
                size = min(window, len(docs[i]))
                chosen.append(docs[i][best : best + size])
                sizes.append(size)
                slope.append((1 / (1 + np.exp(-(means[best] + bias))) - y[i]) * importance[i])
            words = np.concatenate(chosen)
            share = np.repeat(np.array(slope) / np.array(sizes) / len(part), sizes) / per_word[words]
            counts = edges[words + 1] - edges[words]
            flat = np.concatenate([[0], np.cumsum(counts)])
            at = np.arange(flat[-1]) - np.repeat(flat[:-1], counts) + np.repeat(edges[words], counts)
            cells_used, share = cell[at], np.repeat(share, counts)
            force = np.bincount(cells_used, share, cells)
            touched = np.flatnonzero(force)
            step = force[touched, None] * out[None, :] + decay * vectors[touched]
            slope_out = (force[touched, None] * vectors[touched]).sum(axis=0) + decay * out
            g_vectors[touched] += step**2
            vectors[touched] -= rate * step / np.sqrt(g_vectors[touched])
            g_out += slope_out**2
            out = out - rate * 0.2 * slope_out / np.sqrt(g_out)
            slope_bias = float(np.mean(slope))
            g_bias += slope_bias**2
            bias -= rate * 0.2 * slope_bias / np.sqrt(g_bias)
        rate *= 0.93
    return ToxicityModel(vectors @ out, bias, window)


def sample(marks: DataFrame, rows: int = ROWS) -> DataFrame:
    """At most ``rows`` ids of each label (doc_id, toxic), in the order of a hash of the id."""
    of = lambda y: marks.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return of(0).unionByName(of(1))


def within(sizes: list[tuple], chars: int = CHARS) -> list:
    """Ids of (id, label, characters), in their order, as far as each label's ``chars`` go; one that doesn't fit is passed over."""
    left: dict[int, int] = {}
    chosen = []
    for key, label, size in sizes:
        if size <= left.setdefault(label, chars):
            left[label] -= size
            chosen.append(key)
    return chosen


def fit(documents: DataFrame, labels: DataFrame, usable: Column, rows: int = ROWS, chars: int = CHARS, **options) -> ToxicityModel:
    """A model of ``labels.toxic``, from a bounded sample of the labelled rows that are ``usable``.

    The sample is drawn from the ids, which are then broadcast (``2 * rows`` of them at most), so texts are filtered where they
    are read and none is shuffled. Their lengths are summed first (a row counts one more than its characters), and only ids that
    fit ``chars`` of their label, in the order of the hash, are read: the driver gets no more than it trains on. Weights
    give the two labels the shares that they have among all usable rows. Labels that are null or neither 0 nor 1 are left
    out, as are labels without a document; a document with several labels is toxic if one says so.
    """
    marks = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(usable)
    totals = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    docs = documents.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(sample(marks, rows)), "doc_id")
    lengths = docs.groupBy("doc_id", "toxic").agg(F.sum(F.length("text") + 1).alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = within([(r["doc_id"], r["toxic"], r["size"]) for r in lengths.collect()], chars)
    chosen = docs.where(F.col("doc_id").isin(ids)).collect() if ids else []
    chosen.sort(key=lambda r: (len(r["text"]), r["text"]))
    texts, ys = [r["text"] for r in chosen], [int(r["toxic"]) for r in chosen]
    share = {y: totals.get(y, 0) / max(1, ys.count(y)) for y in (0, 1)}
    return train(texts, ys, [share[y] for y in ys], **options)


def scored(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from a score of 0.5) of every row; null texts are empty. Only the text is read."""

    def make(rows):
        for key, text in rows:
            score = model.score(text)
            yield key, score, int(score >= 0.5)

    return map_partition(docs.select("doc_id", text_or_empty().alias("t")), make, "doc_id long, score double, predicted int")
