"""Packing into windows, importance resampling and collocations against plain Python."""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections import Counter, defaultdict
from hashlib import sha256

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from hitframe.llm import collocations, queries, resampling, window_packing
from hitframe.llm.queries import RANKS, ranks
from hitframe.llm.spans import PAD, InternTable, xxhash64
from tests.conftest import SF
from tests.llm.test_edges import LONG, ROWS, nasty, nothing  # noqa: F401

ENDED = 1


def documents(folder=SF):
    return duckdb.sql(f"SELECT doc_id, text, lang FROM '{folder}/documents.parquet'").fetchall()


# ---- packing


def check_windows(rows, wanted: dict, capacity: int) -> None:
    """Pieces give the documents' ids in order, sequences are gapless, and need no padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert by_doc.keys() == wanted.keys()
    for d, ids in wanted.items():
        own = sorted(by_doc[d], key=lambda r: r["start"])
        assert sum(r["length"] for r in own) == len(ids) and all(r["doc_tokens"] == len(ids) for r in own)
        assert own[0]["start"] == 0 and all(b["start"] == a["start"] + a["length"] for a, b in zip(own, own[1:]))
        for r in own:
            data = array("I", ids[r["start"] : r["start"] + r["length"]]).tobytes()
            assert r["ids_crc32"] == zlib.crc32(data) if "ids_crc32" in r else bytes(r["ids"]) == data
    for own in by_sequence.values():
        own.sort(key=lambda r: r["offset"])
        assert own[0]["offset"] == 0 and all(b["offset"] == a["offset"] + a["length"] for a, b in zip(own, own[1:]))
        fill = sum(r["length"] for r in own)
        assert fill <= capacity and (fill == capacity or fill & (fill - 1) == 0)


def test_op11(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    wanted = {d: tokenizer.encode(t or "", add_special_tokens=False).ids + [ENDED] for d, t, _ in documents()}
    rows = [r.asDict() for r in queries.QUERIES["op11_sum_of_squares_packing"](spark, SF).collect()]
    check_windows(rows, wanted, 2048)


def test_level_array_minimises_the_sum_of_squares():
    rng = np.random.default_rng(3)
    levels, counts = window_packing.LevelArray(12), [0] * 13
    for _ in range(600):
        size = int(rng.integers(1, 12))
        after = {}
        for h in range(0, 12 - size + 1):
            if h == 0 or counts[h]:
                now = list(counts)
                now[h] -= h > 0
                now[h + size] += 1
                after[h] = sum(n * n for n in now[1:12])
        best = max(h for h, s in after.items() if s == min(after.values()))
        assert levels.choose(size) == best
        for h, by in ((best, -1), (best + size, 1)):
            if 0 < h < 12:
                counts[h] += by
                levels.change(h, by)


@pytest.mark.parametrize("capacity,most_open", [(16, 1), (16, 5), (64, 4096), (2048, 3)])
def test_packer_keeps_every_id_with_few_windows_open(capacity, most_open):
    rng = np.random.default_rng(capacity + most_open)
    packer, rows, wanted = window_packing.Packer(capacity, 0, most_open), [], {}
    for d in range(400):
        size = int(rng.choice([1, capacity // 2 + 1, capacity // 2 + 1, capacity, capacity + 1, rng.integers(1, 3 * capacity)]))
        wanted[d] = rng.integers(0, 50_000, size).astype(np.uint32)
        rows += packer.put(d, wanted[d].tobytes())
        assert packer.open <= most_open
    rows += packer.end()
    names = ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")
    check_windows([dict(zip(names, r)) for r in rows], {d: ids.tolist() for d, ids in wanted.items()}, capacity)


def test_windows_of_odd_rows(nasty, nothing):  # noqa: F811
    got = [r.asDict() for r in window_packing.pack_documents(nasty, *ranks(RANKS), ENDED).collect()]
    totals = Counter()
    for r in got:
        totals[r["doc_id"]] += r["length"]
    assert totals[3] == totals[4] == 1 and totals[6] > 2048 and len(totals) == len({r[0] for r in ROWS})
    assert totals[2] == 2 * next(r["doc_tokens"] for r in got if r["doc_id"] == 2)
    assert window_packing.pack_documents(nothing, *ranks(RANKS), ENDED).count() == 0


# ---- spans


def test_xxhash64_of_spans_is_that_of_the_library():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 4000).astype(np.uint8).tobytes() + b"\0" * PAD
    starts = rng.integers(0, 3000, 3000)
    lengths = rng.choice([0, 1, 3, 4, 7, 8, 11, 12, 16, 31, 32, 33, 40, 63, 64, 96, 200, 1000], 3000)
    for seed in (0, 9):
        got = xxhash64(np.frombuffer(data, np.uint8), starts, lengths, seed)
        assert got.tolist() == [xxhash.xxh64_intdigest(data[a : a + n], seed) for a, n in zip(starts.tolist(), lengths.tolist())]


@pytest.mark.parametrize("bits", [64, 3, 0])
def test_table_tells_spans_apart_by_their_bytes(bits):
    rng = np.random.default_rng(2)
    data = rng.integers(97, 100, 3000).astype(np.uint8).tobytes() + b"\0" * PAD
    starts, lengths = rng.integers(0, 2900, 900), rng.integers(0, 20, 900)
    buffer = np.frombuffer(data, np.uint8)
    hashes = xxhash64(buffer, starts, lengths) & np.uint64((1 << bits) - 1)  # few bits: different spans with one hash
    table = InternTable(buffer, starts, lengths, hashes)
    spans = [data[a : a + n] for a, n in zip(starts, lengths)]
    assert len(set(zip(spans, table.slots.tolist()))) == len(set(spans)) == len(table.used)
    assert {spans[table.owner[s]]: table.counts[s] for s in table.used} == Counter(spans)


# ---- resampling

FEATURE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def features(text: str | None) -> tuple[int, list[str]]:
    words = FEATURE_WORD.findall(lower(text))
    return len(words), words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) % 10_000


def resampled(docs: list[tuple], target: list[str | None]) -> list[tuple]:
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, features(text)[1]))
    for text in target:
        t.update(map(bucket, features(text)[1]))
    total_s, total_t = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total_s + 10_000.0) / ((s[b] + 1) * (total_t + 10_000.0)))) for b in range(10_000)]
    rows = []
    for d, text in docs:
        n, own = features(text)
        weight = sum(gain[bucket(f)] for f in own) // len(own) if own else 0
        h = int(sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, n, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    place = {id(r): k for k, r in enumerate(order[: 25 * len(order) // 100], 1)}
    return [(r[0], *r[2:], place.get(id(r))) for r in rows]


def test_op12(spark):
    target = [t for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    rows = queries.QUERIES["op12_importance_resampling"](spark, SF).collect()
    assert sorted(tuple(r) for r in rows) == sorted(resampled([(d, t) for d, t, _ in documents()], target), key=lambda r: r[0])


def test_resampling_of_odd_rows(spark, nasty, nothing):  # noqa: F811
    more = spark.createDataFrame([(k, f"word{k % 3} " * 30 + f"x{k}") for k in range(20, 60)], "doc_id long, text string")
    docs = nasty.select("doc_id", "text").unionByName(more)
    target = spark.createDataFrame([("word1 word1 word2",), (None,), ("",)], "text string")
    show = lambda rows: sorted(tuple(-1 if v is None else v for v in r) for r in rows)
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    given = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for marks in (target, target.limit(0)):
        wanted = resampled(given, [r["text"] for r in marks.collect()])
        assert show(resampling.resample(docs, marks).select(columns).collect()) == show(wanted)
    assert resampling.resample(nothing, target).count() == 0


@pytest.mark.parametrize("size,block", [(1, 1), (7, 3), (64, 5), (1 << 20, 1 << 16)])
def test_slices_lose_no_feature(size, block):
    texts = ["", "one", "a bb  ccc, dddd-e", LONG[:3000], "x" * 500 + " y " + "z" * 90, "  " * 80 + "late word" + " " * 99, "é è ü, 日本 語"]
    found = [Counter() for _ in texts]
    for rows, held, again in resampling.slices([np.frombuffer(t.encode(), np.uint8) for t in texts], size):
        words = resampling.Words(held)
        data = words.buffer.tobytes()
        for starts, lengths, text in words.blocks(again, block):
            for a, n, t in zip(starts.tolist(), lengths.tolist(), text.tolist()):
                found[rows[t]][data[a : a + n].decode()] += 1
    assert found == [Counter(features(t)[1]) for t in texts]


# ---- collocations


def phrases_of(rows: list[tuple], least: int, depth: int = 5) -> dict:
    """(lang, phrase): (a, l, r, n, score) by counting everything."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for d in range(1, depth + 1):
                f.update((lang, tuple(words[i : i + d])) for i in range(len(words) - d + 1))
    common = {p for p, a in f.items() if a >= least and len(p[1]) > 1}
    inside = {(lang, w[i : i + k], f[lang, w]) for lang, w in common for k in range(2, len(w)) for i in range(len(w) - k + 1)}
    out = {}
    for lang, w in common:
        a = f[lang, w]
        if (lang, w, a) not in inside:
            cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            out[lang, " ".join(w)] = (a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score)
    return out


def found_phrases(df) -> dict:
    return {(r["lang"], r["phrase"]): (r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect()}


@pytest.mark.parametrize("size,least", [(1 << 20, 100), (4000, 30)])
def test_op13(spark, size, least):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(3)
    got = found_phrases(collocations.collocations(docs, least, size=size))
    wanted = phrases_of([(lang, t) for _, t, lang in documents()], least)
    assert got == wanted and len(wanted) > 20


def test_collocations_of_odd_rows(spark, nasty, nothing):  # noqa: F811
    rows = [("en", "Big Red dog, big red dog. big\tred cat"), (None, "a b a b a b a b"), ("und", "a b"), ("é", "Éa ça; Éa ça\nÉa ça"), ("en", ""), ("en", None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "lang string, text string, phrase int")
    for size in (1, 1 << 20):
        assert found_phrases(collocations.collocations(docs, 2, size=size)) == phrases_of(rows, 2)
    assert found_phrases(collocations.collocations(nasty, 2)) == phrases_of([(r[2], r[1]) for r in ROWS], 2)
    assert collocations.best(collocations.collocations(nothing)).count() == 0


def test_scores_are_exact_and_ranked(spark):
    big = 10**13
    f = [("en", "a", 3 * big), ("en", "b", 7 * big), ("en", "a b", 2 * big), ("en", "b a", 2 * big), ("en", "b b", big)]
    totals = spark.createDataFrame([("en", 10**16 + 1)], "lang string, n long")
    got = collocations.best(collocations.scored(spark.createDataFrame(f, "lang string, phrase string, f long"), totals), 2)
    score = 1000 * 2 * big * (10**16 + 1) // (21 * big * big)
    assert [(r["rank"], r["phrase"], r["score"]) for r in got.orderBy("rank").collect()] == [(1, "a b", score), (2, "b a", score)]


def test_index_counts_every_phrase():
    text = b"to be or not to be, to be. not to be or not to be"
    n, words, bwt = collocations.index_of([np.frombuffer(text, np.uint8)])
    assert n == 15 and sorted(words) == [b"be", b"not", b"or", b"to"]
    intervals, names = collocations.Intervals(bwt.tobytes()), [b"", *words]
    for depth in range(1, 6):
        firsts, counts = intervals.counted()
        got = {" ".join(names[i].decode() for i in ids): c for *ids, c in zip(*intervals.phrase(firsts, depth), counts.tolist())}
        pieces = [p.split() for p in re.split("[,.]", text.decode())]
        assert got == Counter(" ".join(p[i : i + depth]) for p in pieces for i in range(len(p) - depth + 1))
        intervals.deeper()


def test_long_texts_are_cut_at_stops_only():
    raw = np.frombuffer(b"one two. three four five six seven eight nine. ten\neleven", np.uint8)
    parts = [bytes(p) for p in collocations.chunks(raw, 12)]
    assert b"".join(parts) == bytes(raw) and parts[1] == b" three four five six seven eight nine."
    assert [bytes(p) for p in collocations.chunks(raw[:4], 1)] == [b"one "]
