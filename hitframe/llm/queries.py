"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitframe.llm import (
    bitplanes,
    bpe,
    collocations,
    language_mixture,
    ngram_join,
    packing,
    resampling,
    secret_scan,
    stream_dedup,
    template_html,
    toxicity,
    vafile,
    window_packing,
)
from hitframe.llm.common import held_out
from hitframe.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The vocabulary of ``byte_bpe_50k.json`` as ranks.
RANKS = "byte_bpe_50k.tiktoken"
END_OF_DOCUMENT, SEPARATOR, CAPACITY = 0, 2, 1024
WINDOW_END, WINDOW = 1, 2048


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranks(name: str) -> tuple[str, str]:
    return public_tokenizers.path(name), public_tokenizers.PATTERN


@query
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), *ranks("byte_bpe_multi_50k.tiktoken"))


def language_model(docs: DataFrame) -> language_mixture.LanguageModel:
    return language_mixture.fit(docs.where(~held_out()).select("text", "lang"))


@query
def op3_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return language_mixture.identify(rows, language_model(docs)).select("doc_id", "held_out", "lang_pred", "score", "lang_shares")


@query
def op4_template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_html.extract(table(spark, sf_dir, "pages"))


@query
def op5_vector_approximation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


@query
def op6_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


@query
def op7_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), *ranks(RANKS), SEPARATOR, CAPACITY)


@query
def op8_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "ids")
    bitplanes.write_store(table(spark, sf_dir, "documents"), folder, *ranks(RANKS), END_OF_DOCUMENT)
    return bitplanes.read_digests(spark, folder)


@query
def op9_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


@query
def op10_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out())
    scores = toxicity.scored(docs, model)
    return scores.select("doc_id", held_out().alias("held_out"), "score", "predicted")


@query
def op11_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = window_packing.pack_documents(table(spark, sf_dir, "documents"), *ranks(RANKS), WINDOW_END, WINDOW)
    return pieces.withColumn("ids", F.crc32("ids")).withColumnRenamed("ids", "ids_crc32")


@query
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@query
def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations.best(collocations.collocations(table(spark, sf_dir, "documents")))
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLES["op5_vector_approximation"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scores
)
SELECT * FROM ranked WHERE rank <= 10
"""

ORACLES["op12_importance_resampling"] = r"""
WITH crc_table AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c
    FROM range(256) AS r(i))
), texts AS (
  SELECT 'D' AS part, doc_id, row_number() OVER () AS row, text FROM documents
  UNION ALL SELECT 'B', item_id, row_number() OVER (), text FROM benchmark
), words AS (
  SELECT part, doc_id, row,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM texts
), occurrences AS (
  SELECT part, row, unnest(w) AS g FROM words
  UNION ALL
  SELECT part, row, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words
), distinct_bytes AS (
  SELECT g, list_transform(range(0, octet_length(encode(g))), lambda i: CAST('0x' || substr(hex(encode(g)), 2 * i + 1, 2) AS BIGINT)) AS b
  FROM (SELECT DISTINCT g FROM occurrences)
), bucketed AS (
  SELECT g, xor(list_reduce(b, lambda c, x: xor(c >> 8, tab[xor(c & 255, x) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS bucket
  FROM distinct_bytes, crc_table
), placed AS (
  SELECT part, row, bucket FROM occurrences JOIN bucketed USING (g)
), totals AS (
  SELECT count(*) FILTER (part = 'D') AS total_s, count(*) FILTER (part = 'B') AS total_t FROM placed
), gains AS (
  SELECT bucket,
         CAST(floor(1000 * ln((count(*) FILTER (part = 'B') + 1.0::DOUBLE) * (total_s + 10000.0::DOUBLE)
                              / ((count(*) FILTER (part = 'D') + 1.0::DOUBLE) * (total_t + 10000.0::DOUBLE)))) AS BIGINT) AS gain
  FROM placed, totals GROUP BY bucket, total_s, total_t
), summed AS (
  SELECT row, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS total FROM placed JOIN gains USING (bucket) WHERE part = 'D' GROUP BY row
), weighted AS (
  SELECT d.doc_id, len(d.w) >= 20 AS eligible, coalesce(n_features, 0) AS n_features,
         CASE WHEN n_features IS NULL THEN 0 ELSE (total - ((total % n_features) + n_features) % n_features) // n_features END AS weight,
         CAST('0x' || substr(sha256('7:' || d.doc_id), 1, 8) AS BIGINT) AS h
  FROM words AS d LEFT JOIN summed USING (row) WHERE d.part = 'D'
), scored AS (
  SELECT *, CAST(weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM weighted
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY eligible ORDER BY score DESC, doc_id) AS place, count(*) FILTER (eligible) OVER () AS eligible_rows FROM scored
)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, score,
       CASE WHEN eligible AND place <= 25 * eligible_rows // 100 THEN place END AS rank
FROM ranked
"""

ORACLES["op6_stream_dedup"] = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""

ORACLES["op13_phrase_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), places AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words
), runs AS (
  SELECT lang, d, array_to_string(w[i:i + d - 1], ' ') AS phrase FROM places, range(1, 6) AS r(d) WHERE i + d - 1 <= len(w)
), counted AS (
  SELECT lang, d, phrase, count(*) AS f, string_split(phrase, ' ') AS w FROM runs GROUP BY lang, d, phrase
), totals AS (
  SELECT lang, sum(f) AS n FROM counted WHERE d = 1 GROUP BY lang
), common AS MATERIALIZED (
  SELECT * FROM counted WHERE f >= 100
), candidates AS MATERIALIZED (
  SELECT * FROM common WHERE d >= 2
), inner_ones AS (
  SELECT DISTINCT lang, f, array_to_string(w[s:s + k - 1], ' ') AS phrase FROM candidates, range(2, 5) AS a(k), range(1, 6) AS b(s)
  WHERE k < d AND s + k - 1 <= d
), parts AS MATERIALIZED (
  SELECT lang, phrase, f AS a, k, array_to_string(w[1:k], ' ') AS first_part, array_to_string(w[k + 1:], ' ') AS rest
  FROM candidates, range(1, 5) AS p(k) WHERE k < d
), cuts AS (
  SELECT parts.lang, parts.phrase, a, k, l.f AS l, r.f AS r, (1000 * CAST(a AS HUGEINT) * n) // (CAST(l.f AS HUGEINT) * r.f) AS score
  FROM parts
  JOIN common AS l ON l.lang = parts.lang AND l.phrase = first_part
  JOIN common AS r ON r.lang = parts.lang AND r.phrase = rest
  JOIN totals ON totals.lang = parts.lang
), best AS (
  SELECT * FROM cuts WHERE NOT EXISTS (SELECT 1 FROM inner_ones AS i WHERE i.lang = cuts.lang AND i.phrase = cuts.phrase AND i.f = cuts.a)
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r,
         CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
  FROM best JOIN totals USING (lang)
)
SELECT * FROM ranked WHERE rank <= 2000
"""
