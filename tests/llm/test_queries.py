"""The registered queries on the smallest tables, against plain Python."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from array import array
from collections import defaultdict

import duckdb
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from hitframe.llm import queries
from tests.conftest import SF
from tests.llm.brute import components, kept_rows, shingles, spans_of

RUN: dict[str, list] = {}


@pytest.fixture(scope="module")
def result(spark):
    def get(number: int):
        name = next(n for n in queries.QUERIES if n.startswith(f"op{number}_"))
        if name not in RUN:
            RUN[name] = [r.asDict() for r in queries.QUERIES[name](spark, SF).collect()]
        return RUN[name]

    return get


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{SF}/documents.parquet'").fetchall()


def held(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_op1(result, docs):
    sets = {d: shingles(t) for d, t, *_ in docs}
    wanted = components(sets)
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in result(1)} == {(d, len(s), wanted[d]) for d, s in sets.items()}
    assert len(set(wanted.values())) < len(wanted)


def test_op2(result, docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    wanted = {}
    for d, t, *_ in docs:
        ids = plain.encode_ordinary(t or "")
        wanted[d] = (len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in result(2)} == wanted


def test_op3(result, docs):
    truth = {d: lang for d, _, lang, _ in docs}
    rows = result(3)
    assert len(rows) == len(docs)
    assert all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)
    own = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in own) >= 0.95 * len(own)


def test_op4(result):
    pages = duckdb.sql(f"SELECT page_id, url, html FROM '{SF}/pages.parquet'").fetchall()
    got = {r["page_id"]: r for r in result(4)}
    assert len(got) == len(pages)
    import html

    for page_id, url, source in pages:
        inner = re.sub(r"(?s)^.*<article>|</article>.*$", "", source)
        blocks = re.split(r"</?(?:p|h1|br)\b[^>]*>", inner)
        wanted = " ".join(b for b in (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks) if b)
        assert (got[page_id]["url"], got[page_id]["text"], got[page_id]["n_chars"]) == (url, wanted, len(wanted))


def against_sql(result, number):
    name = next(n for n in queries.ORACLES if n.startswith(f"op{number}_"))
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rows = con.sql(queries.ORACLES[name])
    got = result(number)
    assert sorted(got[0]) == sorted(rows.columns)
    assert sorted(tuple(r[c] for c in rows.columns) for r in got) == sorted(rows.fetchall())


def test_op5(result):
    against_sql(result, 5)


def test_op6(result, docs):
    against_sql(result, 6)
    assert {(r["doc_id"], r["keep_id"]) for r in result(6)} == set(kept_rows([(d, t) for d, t, *_ in docs]).items())


def ids_of(text: str, end: int) -> list[int]:
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids + [end]


def test_op7(result, docs):
    rows = result(7)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    assert set(by_doc) == {d for d, *_ in docs}
    for d, t, *_ in docs:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        own = sorted(by_doc[d], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert own[0]["start"] == 0 and all(b["start"] == a["start"] + a["length"] for a, b in zip(own, own[1:]))
        assert sum(r["length"] for r in own) == len(ids) and all(r["length"] == 1024 for r in own[1:]) and 0 < own[0]["length"] <= 1024
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(array("I", ids[r["start"] : r["start"] + r["length"]]).tobytes())
    for own in by_sequence.values():
        own.sort(key=lambda r: r["offset"])
        assert own[0]["offset"] == 0 and all(b["offset"] == a["offset"] + a["length"] for a, b in zip(own, own[1:]))
        assert sum(r["length"] for r in own) <= 1024
    assert len(by_sequence) <= 1.02 * -(-sum(r["length"] for r in rows) // 1024) + 1


def test_op8(result, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    wanted, start = {}, 0
    for d, t, *_ in sorted(docs):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        wanted[d] = (start, len(ids), zlib.crc32(array("I", ids).tobytes()))
        start += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in result(8)} == wanted


def test_op9(spark):
    folder = "/root/testdata/sf0.01"  # the smallest documents hold no secrets
    wanted = {}
    for d, t in duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet'").fetchall():
        spans = spans_of(t or "")
        shown = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        wanted[d] = (*(sum(k == kind for k, *_ in spans) for kind in ("assign", "access", "hex")), hashlib.sha256(shown.encode()).hexdigest(), shown)
    got = {r["doc_id"]: r for r in queries.QUERIES["op9_secret_ownership"](spark, folder).collect()}
    assert {d: (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for d, r in got.items()} == {d: w[:4] for d, w in wanted.items()}
    assert all(set(filter(None, wanted[d][4].split(","))) <= set(r["spans"].split(",")) for d, r in got.items())
    assert any(w[4] for w in wanted.values())


def test_op10(spark):
    folder = "/root/testdata/sf0.1"  # the smallest tables have too few toxic documents to learn from
    name = next(n for n in queries.QUERIES if n.startswith("op10_"))
    got = queries.QUERIES[name](spark, folder).collect()
    truth = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{folder}/labels.parquet'").fetchall())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == held(r["doc_id"]) for r in got)
    own = [(r["score"], truth[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in truth]
    toxic, clean = [s for s, y in own if y], [s for s, y in own if not y]
    assert sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) >= 0.92 * len(toxic) * len(clean)
    assert sum(s >= 0.5 for s in clean) <= 0.02 * len(clean)


def test_pipeline(spark, docs):
    import corpus_pipeline

    rows = [r.asDict() for r in corpus_pipeline.run(spark, SF).collect()]
    lettered = [(d, t) for d, t, *_ in docs if t and re.search(r"[^\W\d_]", t)]
    keep = kept_rows(lettered)
    alone = {d: shingles(t) for d, t in lettered if keep[d] == d}
    groups = components(alone)
    assert {r["doc_id"] for r in rows} == {d for d in alone if groups[d] == d}
