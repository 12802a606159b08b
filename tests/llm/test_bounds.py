"""Work and memory that must not grow faster than a text, and what templates must leave alone."""

from __future__ import annotations

import random
import re
import time

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from hitframe.llm import collocations, common, ngram_join, secret_scan, stream_dedup, template_html, toxicity
from tests.llm.test_whole_job import texts

PAGE = "<html><body><nav>menu</nav><article><h1>{}</h1><p>{}</p><p>{}</p><p>{}</p></article><footer>foot</footer></body></html>"


def test_editions_of_an_article_keep_what_they_share(spark):
    pages = [PAGE.format("The story", f"Edition {i}", "First part.", "Second part.") for i in range(3)]
    pages += [PAGE.format(f"Other {i}", f"text {i}", f"more {i}", f"end {i}") for i in range(3)]
    got = texts(spark, pages)
    assert got == [f"The story Edition {i} First part. Second part." for i in range(3)] + [f"Other {i} text {i} more {i} end {i}" for i in range(3)]


def test_texts_of_all_articles_go_from_five_pages_on(spark):
    pages = [PAGE.format(f"Title {i}", f"text {i}", "Conclusion", "Share this") for i in range(5)]
    assert texts(spark, pages) == [f"Title {i} text {i}" for i in range(5)]
    assert texts(spark, pages[:4]) == [f"Title {i} text {i} Conclusion Share this" for i in range(4)]


def test_unclosed_boxes_take_linear_time_and_space():
    deep = "<div class='a'>" * 100_000
    begin = time.monotonic()
    assert template_html.main_text(f"<body>{deep}the text{'</section>' * 100_000}", [(0, 1)]) == "the text"
    assert time.monotonic() - begin < 20
    assert max(len(t[0]) for t in template_html.parse(deep).tokens) < 40


def test_labelled_texts_are_chosen_within_a_budget_of_each_label():
    sizes = [(1, 0, 60), (2, 1, 10), (3, 0, 50), (4, 0, 40), (5, 1, 1000), (6, 1, 90)]
    assert toxicity.within(sizes, 100) == [1, 2, 4, 6]


def test_very_long_labelled_texts_stay_off_the_driver(spark):
    docs = spark.createDataFrame([(i, ("idiot " if i % 2 else "friend ") * (50_000 if i < 4 else 3)) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, labels["doc_id"] >= 0, chars=1000)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.scored(docs, model).collect()}
    assert got == {i: i % 2 for i in range(40)}


def brute_spans(text: str) -> list[tuple]:
    base = [(m.start(), 0, m.end(), "assign") for m in re.finditer(secret_scan.ASSIGN, text) if len(m[2]) >= secret_scan.LEAST_VALUE]
    base += [(m.start(), 1, m.end(), "access") for m in re.finditer(secret_scan.ACCESS, text)]
    base += [(m.start(), 2, m.end(), "hex") for m in re.finditer(secret_scan.HEX, text)]
    opaque = [(m.start(), 3, m.end(), "opaque") for m in re.finditer(secret_scan.OPAQUE, text) if all(re.search(p, m[0]) for p in ("[a-z]", "[A-Z]", "[0-9]"))]
    return sorted(base + [o for o in opaque if not any(b[0] < o[2] and o[0] < b[2] for b in base)])


def brute_mask(text: str, spans: list[tuple], live: list[bool]) -> str:
    at, parts = 0, []
    for (start, _, end, _), one in zip(spans, live):
        parts += [text[at : max(start, at)], "" if start < at else "[secret]" if one else "[example]"]
        at = max(at, end)
    return "".join(parts) + text[at:]


def test_spans_and_masks_equal_the_plain_form(spark):
    rng = random.Random(9)
    pieces = ["password = ", "Token:", "'", " ", "\n", "é", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef01234567", "aB3" * 12, "example", "x/", "日本"]
    rows = [(i, "".join(rng.choices(pieces, k=rng.choice([0, 3, 30, 900]))), f"o{i % 9}/r") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    judged = {r["doc_id"]: r["judged"] for r in secret_scan.judged(docs).collect()}
    masked = {r["doc_id"]: r["text"] for r in secret_scan.redacted(docs).collect()}
    for key, text, _ in rows:
        want = brute_spans(text)
        assert [(s["start"], s["kind_order"], s["end"], s["kind"]) for s in judged[key]] == want
        shown = [(s, j["live"]) for s, j in zip(want, judged[key]) if s[3] != "opaque" or j["live"]]
        assert masked[key] == brute_mask(text, [s for s, _ in shown], [one for _, one in shown])
    assert any(s["kind"] == "opaque" for own in judged.values() for s in own)


def test_a_text_of_very_many_matches(spark):
    text = "".join(f"{i:026x} and words " for i in range(100_000))
    docs = spark.createDataFrame([(1, text, "a/r")], "doc_id long, text string, source string")
    begin = time.monotonic()
    assert secret_scan.scan(docs).first()["n_hex"] == 100_000
    assert secret_scan.redacted(docs).first()["text"] == "[secret] and words " * 100_000
    assert time.monotonic() - begin < 120


def test_batches_are_closed_by_the_bytes_of_arrays_too():
    rows = ((np.zeros(1 << 14, np.int64),) for _ in range(64))  # 8 MB in 64 rows
    batches = list(common.batches_of(rows, common.arrow_schema("codes array<long>")))
    assert sum(b.num_rows for b in batches) == 64 and len(batches) >= 4


def test_batches_of_long_texts_are_closed_by_their_bytes(spark):
    common.small_batches(spark)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])

    got = spark.range(0, 48, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("text")).mapInArrow(sizes, "n long, bytes long").collect()
    assert sum(r["n"] for r in got) == 48 and max(r["bytes"] for r in got) <= 4 << 20


def test_blocks_of_open_groups_are_read_by_a_few_megabytes(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_CODES", 1 << 14)
    docs = spark.createDataFrame([(i, " ".join(f"t{i}w{k}" for k in range(20_000))) for i in range(60)], "doc_id long, text string")
    sets = ngram_join.sketches(docs).withColumn("key", F.lit(1).cast("long"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        blocks = ngram_join.Links(docs, sets.drop("key")).blocks(sets.select("key", "set_id"), docs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in blocks.inputFiles()]
    groups = [m.row_group(k).total_byte_size for m in files for k in range(m.num_row_groups)]
    assert sum(groups) > 60 * 20_000 * 8 * 0.99 and max(groups) < 6 << 20


def test_state_stores_are_opened_for_reading_once_and_with_bounded_memory(spark, monkeypatch):
    seen, write = [], stream_dedup.written

    def spy(df, name, **options):
        if "batchscan" in df._jdf.queryExecution().toString().lower():
            seen.append({k: spark.conf.get(k, None) for k in stream_dedup.SETTINGS})
        return write(df, name, **options)

    monkeypatch.setattr(stream_dedup, "written", spy)
    before = {k: spark.conf.get(k, None) for k in stream_dedup.SETTINGS}
    docs = spark.createDataFrame([(1, "a b"), (2, "a  b"), (3, "c"), (4, None)], "doc_id long, text string")
    for got, n in ((stream_dedup.exact_duplicates(docs), 4), (stream_dedup.without_duplicates(docs), 3)):
        assert "batchscan" not in got._jdf.queryExecution().toString().lower() and got.count() == n
    assert seen == [stream_dedup.SETTINGS] * 2
    assert before == {k: spark.conf.get(k, None) for k in stream_dedup.SETTINGS}


def test_shards_of_phrases_are_read_one_by_one_and_dealt_to_tasks_by_their_number(spark, monkeypatch):
    seen, write = {}, collocations.written

    def spy(df, name, **options):
        made = write(df, name, **options)
        seen[name] = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in made.inputFiles()]
        return made

    monkeypatch.setattr(collocations, "written", spy)
    monkeypatch.setattr(collocations, "BUCKET_KEYS", 1 << 17)
    rng = np.random.default_rng(3)
    docs = spark.createDataFrame([("en", " ".join(f"w{k}" for k in rng.integers(0, 100_000, 150_000))) for _ in range(12)], "lang string, text string")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", *common.BATCHES)}
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        collocations.collocations(docs.coalesce(1), least=10, size=1 << 19)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    shards = [m.row_group(k) for m in seen["shards"] for k in range(m.num_row_groups)]
    assert sum(g.num_rows for g in shards) == 12 and max(g.total_byte_size for g in shards) < 6 << 20
    assert len([m for m in seen["alive"] if m.num_rows]) > 5  # 2 shuffle partitions, 28 buckets
