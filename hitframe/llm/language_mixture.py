"""Language shares of documents: expectation-maximisation over byte n-gram likelihoods, languages chosen by penalised likelihood."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, MapType, StringType

from hitframe.llm.common import arrow_schema, give_back

UNKNOWN = "und"
#: Hash cells of the n-grams, and n-gram lengths in bytes.
CELLS, LENGTHS = 1 << 13, (2, 3, 4)


def _byte_classes() -> np.ndarray:
    """ASCII letters in lower case and all other bytes above 127 as they are; everything else separates words."""
    table = np.full(256, 32, np.uint8)
    table[97:123] = table[65:91] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table


def gram_cells(data: bytes, cells: int = CELLS, lengths: tuple[int, ...] = LENGTHS) -> np.ndarray:
    """Hash cells of the n-grams of a text that hold a letter; word edges count as a space, digits and signs as nothing."""
    raw = _byte_classes()[np.frombuffer(b" " + data + b" ", np.uint8)]
    keep = np.ones(len(raw), bool)
    keep[1:] = (raw[1:] != 32) | (raw[:-1] != 32)  # runs of separators are one
    raw = raw[keep].astype(np.uint32)
    out = []
    for n in lengths:
        if len(raw) < n:
            continue
        code = np.zeros(len(raw) - n + 1, np.uint32)
        for k in range(n):
            code = code * np.uint32(0x01000193) + raw[k : len(raw) - n + 1 + k]
        code ^= code >> np.uint32(15)
        code *= np.uint32(0x2C1B3C6D)
        out.append((code >> np.uint32(12)) % np.uint32(cells))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def counts_of(text: str, cells: int) -> np.ndarray:
    """Counts per cell of a whole text, piece by piece for long ones."""
    total, data = np.zeros(cells, np.float32), text.encode("utf-8", "replace")
    for at in range(0, max(1, len(data)), 1 << 20):
        total += np.bincount(gram_cells(data[at : at + (1 << 20)], cells), minlength=cells)
    return total


@dataclass(frozen=True)
class LanguageModel:
    """Share of every n-gram cell in each language."""

    languages: tuple[str, ...]
    likelihood: np.ndarray  # (cells, languages)


def fit(labelled: DataFrame, cells: int = CELLS, smoothing: float = 0.5) -> LanguageModel:
    """Likelihoods from every labelled row (``text``, ``lang``): all rows count, rows without either are left out.

    Tasks add up their counts per language and cell before the shuffle; the driver gets the sums, ``cells`` numbers for a
    language. Labels are language names, so their number doesn't grow with the rows.
    """

    schema = arrow_schema("lang string, cell int, n long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    held = sums.setdefault(lang, np.zeros(cells, np.float64))
                    held += counts_of(text, cells)
        give_back()
        for lang, held in sums.items():
            used = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(used)), pa.array(used.astype(np.int32)), pa.array(held[used].astype(np.int64))],
                schema=schema,
            )

    rows = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("lang", "text")
    sums = rows.mapInArrow(count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    table = sums.toPandas()
    languages = tuple(sorted(table["lang"].unique()))
    counts = np.zeros((cells, len(languages)))
    for k, lang in enumerate(languages):
        own = table[table["lang"] == lang]
        counts[own["cell"].to_numpy(), k] = own["n"].to_numpy()
    shares = (counts + smoothing) / (counts.sum(axis=0) + smoothing * cells) if languages else counts
    return LanguageModel(languages, shares.astype(np.float32))


def _maximise(counts: np.ndarray, like: np.ndarray, share: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares after ``steps`` rounds, and the log-likelihoods; shares of 0 stay 0."""
    total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
    for _ in range(steps):
        share = share * ((counts / np.maximum(share @ like.T, 1e-30)) @ like) / total
    return share, (counts * np.log(np.maximum(share @ like.T, 1e-30))).sum(axis=1)


def mixtures(counts: np.ndarray, model: LanguageModel, steps: int = 12, penalty: float = 2.0) -> np.ndarray:
    """Language shares of documents (rows of ``counts``).

    Starts with all languages and drops the one with the least share as long as that raises the log-likelihood less
    ``penalty * log(n-grams)`` for each language that is left.
    """
    like, n = model.likelihood, len(model.languages)
    share = np.full((len(counts), n), 1 / n, np.float32)
    share, best = _maximise(counts, like, share, steps)
    cost = penalty * np.log(np.maximum(counts.sum(axis=1), 2))
    going = np.arange(len(counts))
    for _ in range(n - 1):
        rest = share[going]
        weakest = np.where(rest > 0, rest, np.inf).argmin(axis=1)
        rest[np.arange(len(going)), weakest] = 0
        rest /= np.maximum(rest.sum(axis=1, keepdims=True), 1e-30)
        fitted, value = _maximise(counts[going], like, rest, max(2, steps // 3))
        better = value + cost[going] >= best[going]
        going, fitted, value = going[better], fitted[better], value[better]
        share[going], best[going] = fitted, value
        if not len(going):
            break
    return share / np.maximum(share.sum(axis=1, keepdims=True), 1e-30)


def identify(docs: DataFrame, model: LanguageModel, docs_at_once: int = 64) -> DataFrame:
    """Columns of ``docs`` and ``lang_pred``, ``score`` (its share of the document), ``lang_shares`` (language to share).

    ``und`` with score 0 where the text is null or has no letter, or where no language was learned. Only the text is read.
    Columns of these names that ``docs`` has are replaced.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "lang_shares")]
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    schema = docs.select(*kept).schema
    out = schema.add("lang_pred", "string").add("score", "double").add("lang_shares", MapType(StringType(), DoubleType()))
    languages = model.languages
    at = kept.index("text")
    wanted = to_arrow_schema(out)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, docs_at_once):
                batch = whole.slice(first, docs_at_once)
                names, scores, shares = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows, [{}] * batch.num_rows
                lettered = batch.column(len(kept)).to_pylist()
                rows = [i for i, ok in enumerate(lettered) if ok and languages]
                if rows:
                    texts = batch.column(at)
                    counts = np.stack([counts_of(texts[i].as_py(), len(model.likelihood)) for i in rows])
                    for i, share in zip(rows, mixtures(counts, model)):
                        k = int(share.argmax())
                        names[i], scores[i] = languages[k], min(1.0, float(share[k]))
                        shares[i] = {languages[j]: float(share[j]) for j in np.flatnonzero(share > 0)}
                columns = [*batch.columns[: len(kept)], pa.array(names), pa.array(scores), pa.array([list(s.items()) for s in shares], wanted.types[-1])]
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, wanted.types)], schema=wanted)

    return docs.select(*kept, letters.alias("__letters")).mapInArrow(predict, out)


def language(model: LanguageModel, text: str = "text", docs_at_once: int = 64) -> Column:
    """The language of a text as ``identify`` tells it. Only the text goes to Python and only the name comes back."""
    languages = model.languages

    def predict(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for whole in arrays:
            names: list[str] = []
            for first in range(0, len(whole), docs_at_once):
                texts = whole.slice(first, docs_at_once).to_pylist()
                rows = [i for i, t in enumerate(texts) if t is not None and languages]
                found = [UNKNOWN] * len(texts)
                if rows:
                    counts = np.stack([counts_of(texts[i], len(model.likelihood)) for i in rows])
                    for i, share in zip(rows, mixtures(counts, model)):
                        found[i] = languages[int(share.argmax())]
                names += found
            yield pa.array(names, pa.string())
        give_back()

    return F.arrow_udf(predict, "string", F.ArrowUDFType.SCALAR_ITER)(F.when(F.col(text).rlike(r"\p{L}"), F.col(text)))
