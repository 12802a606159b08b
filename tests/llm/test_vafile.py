"""The approximation file: bounds hold, few exact vectors are read, results equal the brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hitframe.llm import vafile


@pytest.mark.parametrize("scale", [1, 40, 1e6, 1e12, 1e30])
def test_bounds_hold_the_exact_products(scale):
    rng = np.random.default_rng(3)
    exact, query = np.floor(rng.normal(0, scale, (500, 24))), np.floor(rng.normal(0, scale, (5, 24)))
    low, high = vafile.bounds(query, *vafile.approximate(exact))
    for q in range(5):
        for i in range(0, 500, 7):
            true = sum(int(a) * int(b) for a, b in zip(query[q], exact[i]))
            assert low[q, i] <= true <= high[q, i]


def brute(rows: list[tuple], k: int) -> list[tuple]:
    rows = {(key, tuple(v)) for key, v in rows}
    out = []
    for query in {key for key, _ in rows if key % 100 == 0}:
        scores = [
            (-sum(math.floor(1024 * a) * math.floor(1024 * b) for a, b in zip(own, v)), key)
            for q, own in rows if q == query for key, v in rows if key != query and len(v) == len(own)
        ]
        out += [(query, rank, key, -s) for rank, (s, key) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def test_copies_repeats_and_dimensions_equal_the_brute_force(spark):
    rng = np.random.default_rng(4)
    hot = [2.0, 2.0, 2.0]
    rows = [(i, hot if i % 3 == 0 else rng.normal(size=3 if i % 4 else 2).tolist()) for i in range(700)]
    rows += rows[:50] + [(900, hot)] * 30 + [(1000, [1e12, -3.0]), (1001, [2.0, 1e11])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vafile.exact_top_k(vectors, F.col("vec_id") % 100 == 0, 4).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == brute(rows, 4)


def test_few_exact_vectors_are_read(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    pairs, searches, rows = vafile.survivors(vectors, F.col("vec_id") % 100 == 0)
    assert pairs.count() < 0.05 * searches.count() * rows.count()
