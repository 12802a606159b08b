"""Byte-level BPE: encoding with the tiktoken library and a local rank file, and decoding of the raw bytes."""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame

from hitframe.llm.common import map_partition, per_worker, text_or_empty

#: Characters after which a long text is cut at the next safe boundary.
LONG = 1 << 16
#: White space at the end of the split pattern of rank files that needs a look-ahead, and the form without one.
AHEAD, PLAIN = r"|\s+(?!\S)|\s+", r"|\s+"
#: One space between two characters that are no white space: no match of the pattern reaches over it, and what stands on
#: one side has no influence on the matches of the other.
SAFE = re.compile(r"(?<=\S) (?=\S)")
RUN = re.compile(r"\s\s")


def safe_pieces(text: str, long: int = LONG) -> Iterator[str]:
    """``text`` in pieces of about ``long`` characters, cut only at safe boundaries; without one, in one piece."""
    at = 0
    while len(text) - at > long and (cut := SAFE.search(text, at + long)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


class RankFile:
    """Ids of texts by the ranks of a ``.tiktoken`` file.

    ``pattern`` splits a text; every match is merged by itself. A piece without two white-space characters in a row
    gives the same matches without the look-ahead of the pattern, which is about twice as fast.
    """

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.full = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.plain = self.full
        if pattern.endswith(AHEAD):
            shorter = pattern.removesuffix(AHEAD) + PLAIN
            self.plain = tiktoken.Encoding("plain", pat_str=shorter, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> array:
        """Ids as an array of unsigned 32-bit integers; strings of special tokens are ordinary text."""
        out = array("I")
        for piece in safe_pieces(text):
            out.extend((self.full if RUN.search(piece) else self.plain).encode_ordinary(piece))
        return out

    def decoded(self, ids) -> bytes:
        """The raw bytes of ids; they need not be valid UTF-8 where ids were cut."""
        return self.full.decode_bytes(list(ids))


def rank_file(path: str, pattern: str) -> RankFile:
    return per_worker(("ranks", path, pattern), lambda: RankFile(path, pattern))


def little_endian(ids: array) -> bytes:
    import sys

    if sys.byteorder == "big":
        ids = array("I", ids)
        ids.byteswap()
    return ids.tobytes()


def encode(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, ``n_tokens``, ``ids`` (little-endian unsigned 32-bit integers). A null text is empty.

    ``path`` names the rank file on every worker. No shuffle; a worker holds one document's ids at a time.
    """

    def make(rows):
        ranks = rank_file(path, pattern)
        for key, value in rows:
            ids = ranks.ids(value)
            yield key, len(ids), little_endian(ids)

    return map_partition(docs.select(id_column, text_or_empty(text).alias("t")), make, f"{id_column} long, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str, id_column: str = "doc_id") -> DataFrame:
    """The raw bytes of ``encode``'s rows: id, ``bytes``. Null ids give null."""

    def make(rows):
        ranks = rank_file(path, pattern)
        for key, ids in rows:
            yield key, None if ids is None else ranks.decoded(array("I", ids))

    return map_partition(encoded.select(id_column, "ids"), make, f"{id_column} long, bytes binary")


def round_trip_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode and decode every text in one pass: ``n_tokens``, SHA-256 of the ids and of the decoded bytes.

    Columns other than ``doc_id`` and ``text`` are ignored; every input row gives one output row, repeated rows and null
    ids included; a null text counts as empty (0 tokens, digests of nothing).
    """

    def make(rows):
        ranks = rank_file(path, pattern)
        for key, value in rows:
            ids = ranks.ids(value)
            yield key, len(ids), hashlib.sha256(little_endian(ids)).hexdigest(), hashlib.sha256(ranks.decoded(ids)).hexdigest()

    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_partition(docs.select("doc_id", text_or_empty().alias("t")), make, ddl)
