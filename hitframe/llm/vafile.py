"""Exact top-k inner products with a vector-approximation file.

Components are whole numbers. The approximation file has them as one byte each: the number of a cell between a block's least and
greatest component. Queries scan the cells alone, which bounds every inner product from both sides. What can still be among the
best of all blocks is then joined with the exact vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitframe.llm.common import map_partition
from hitframe.session import written

SCALE = 1024
#: Vectors of a block of the approximation file and of a query block, candidate blocks that meet a query block in one task, cells of a component.
CANDIDATES, QUERIES, LANE, CELLS = 8192, 256, 4, 256
#: Sums of products below this are exact in doubles.
EXACT = 2.0**53


def takes_part(embedding: Column) -> Column:
    """The vector is there and all its components are finite numbers."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embedding.isNotNull() & F.coalesce(fine, F.lit(False))


def whole(vectors: list) -> np.ndarray:
    """floor(1024 * x) of vectors of one dimension, as doubles."""
    return np.floor(SCALE * np.array(vectors, np.float64).reshape(len(vectors), -1))


def grouped(rows: Iterator[tuple], size: int) -> Iterator[list[tuple]]:
    """Rows whose last value is a vector, in lists of at most ``size`` of one dimension."""
    held: dict[int, list] = {}
    for row in rows:
        own = held.setdefault(len(row[-1]), [])
        own.append(row)
        if len(own) == size:
            yield held.pop(len(row[-1]))
    yield from held.values()


def approximate(exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell numbers (n, dim) of whole numbers, and per component the least value and the width of a cell (2, dim)."""
    least = exact.min(axis=0, initial=np.inf)
    width = np.maximum(1, np.ceil((exact.max(axis=0, initial=-np.inf) - least + 1) / CELLS))
    return np.clip(np.floor((exact - least) / width), 0, CELLS - 1).astype(np.uint8), np.array([least, width])


def bounds(query: np.ndarray, cells: np.ndarray, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds (queries, vectors) of inner products with vectors that are known by their cells."""
    least, width = grid
    base = (query * width) @ cells.T.astype(np.float64) + (query @ least)[:, None]
    spare = width - 1
    # sums that are not exact in doubles get room for their rounding
    size = np.abs(query) @ (np.abs(least) + CELLS * width)
    room = np.where(size < EXACT, 0, 8 * (len(least) + 1) * np.finfo(float).eps * size)
    lower, upper = np.minimum(query, 0) @ spare - room, np.maximum(query, 0) @ spare + room
    low, high = base + lower[:, None], base + upper[:, None]
    return np.where(np.isnan(low), -np.inf, low), np.where(np.isnan(high), np.inf, high)


def scan(query: np.ndarray, own: np.ndarray, ids: np.ndarray, cells: np.ndarray, grid: np.ndarray, k: int) -> Iterator[tuple]:
    """(query number, vector number, lower, upper) of the vectors that may be among a query's ``k`` best of the block.

    ``ids`` has the smallest id of each vector's rows. Where that is the query's own, the lower bound is null and proves nothing.
    """
    low, high = bounds(query, cells, grid)
    for q in range(len(query)):
        proves = ids != own[q]
        known = low[q][proves]
        floor = np.partition(known, -k)[-k] if len(known) >= k else -np.inf
        for i in np.flatnonzero(high[q] >= floor).tolist():
            yield q, i, float(low[q][i]) if proves[i] else None, float(high[q][i])


def score(a: list[float], b: list[float]) -> int:
    """The inner product of two vectors' whole numbers, exact at any size."""
    x, y = whole([a, b])
    if np.abs(x) @ np.abs(y) < EXACT:
        return int(x @ y)
    return sum(int(p) * int(q) for p, q in zip(x, y))


def survivors(vectors: DataFrame, is_query: Column, k: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What has to be read exactly: pairs (search, row), searches (search, query_id, vector) and rows (row, ids, vector).

    Equal vectors are one row with their ``k + 1`` smallest ids: no query can have more of them among its best. Query blocks and blocks
    of the approximation file meet in a grid; only cells travel there. The kth greatest lower bound over all blocks settles
    which pairs stay. Memory is bounded by the block sizes, and no side is broadcast or collected.
    """
    vector = F.col("embedding").cast("array<double>").alias("vector")
    valid = vectors.where(F.col("vec_id").isNotNull() & takes_part(F.col("embedding"))).select("vec_id", vector, is_query.alias("asked"))
    first = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    members = valid.select("vec_id", "vector").dropDuplicates().withColumn("place", first).where(F.col("place") <= k + 1)
    classes = members.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    rows = written(classes.select(F.monotonically_increasing_id().alias("row"), "ids", "vector"), "vectors")
    asked = valid.where("asked").select(F.col("vec_id").alias("query_id"), "vector").dropDuplicates()
    searches = written(asked.select(F.monotonically_increasing_id().alias("search"), "query_id", "vector"), "searches")

    def approximation(read):
        for own in grouped(read, CANDIDATES):
            cells, grid = approximate(whole([v for *_, v in own]))
            yield len(own[0][-1]), np.array([r[:2] for r in own], np.int64).tobytes(), cells.tobytes(), grid.tobytes()

    def asking(read):
        for own in grouped(read, QUERIES):
            yield len(own[0][-1]), np.array([r[:2] for r in own], np.int64).tobytes(), whole([v for *_, v in own]).tobytes()

    number = F.monotonically_increasing_id()
    sides = map_partition(rows.select("row", F.col("ids")[0], "vector"), approximation, "dim int, keys binary, cells binary, grid binary")
    sides = written(sides.withColumn("number", number), "approximation")
    queries = written(map_partition(searches, asking, "dim int, q_keys binary, q_exact binary").withColumn("number", number), "query-blocks")

    # every query block of a dimension has a number from 1; a lane is some blocks of the approximation file
    dense = queries.select("dim", "number", F.row_number().over(Window.partitionBy("dim").orderBy("number")).alias("block"))
    queries = queries.join(dense, ["dim", "number"]).select("dim", "block", "q_keys", "q_exact")
    per_dim = dense.groupBy("dim").agg(F.max("block").alias("n_blocks"))
    lanes = max(1, math.ceil(sides.count() / LANE))
    spread = sides.withColumn("lane", F.pmod(F.xxhash64("number"), F.lit(lanes))).join(per_dim, "dim")
    spread = spread.select("dim", "lane", "keys", "cells", "grid", F.explode(F.sequence(F.lit(1), "n_blocks")).alias("block"))
    met = spread.join(queries.withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long")))), ["dim", "lane", "block"])

    def meet(read):
        for dim, keys, cells, grid, q_keys, q_exact in read:
            known, own = np.frombuffer(keys, np.int64).reshape(-1, 2), np.frombuffer(q_keys, np.int64).reshape(-1, 2)
            code, query = np.frombuffer(cells, np.uint8).reshape(len(known), dim), np.frombuffer(q_exact).reshape(len(own), dim)
            for q, i, low, high in scan(query, own[:, 1], known[:, 1], code, np.frombuffer(grid).reshape(2, dim), k):
                yield int(own[q, 0]), int(known[i, 0]), low, high

    found = map_partition(met.select("dim", "keys", "cells", "grid", "q_keys", "q_exact"), meet, "search long, row long, low double, high double")
    found = written(found, "bounds")
    greatest = F.row_number().over(Window.partitionBy("search").orderBy(F.desc("low")))
    kth = found.where("low IS NOT NULL").withColumn("place", greatest).where(F.col("place") <= k).where(F.col("place") == k).select("search", F.col("low").alias("floor"))
    pairs = found.join(kth, "search", "left").where(F.col("floor").isNull() | (F.col("high") >= F.col("floor"))).select("search", "row")
    return pairs, searches, rows


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """The ``k`` vectors with the highest inner products for every query row: query_id, rank, vec_id, score.

    Components x are floor(1024 * x). ``vectors`` has ``vec_id`` and ``embedding``; other columns are ignored. Rows with a
    null id, a null vector, or a null or non-finite component take no part; vectors of different dimensions have no
    score; a query is never its own candidate, nor are rows that repeat its id. Rows that repeat id and vector count once; a query
    id with several vectors gets the best of all of them in one ranking. Fewer than ``k`` candidates: all of them. Scores beyond a
    long raise an error.
    """
    pairs, searches, rows = survivors(vectors, is_query, k)
    read = pairs.join(rows, "row").join(searches.withColumnRenamed("vector", "q_vector"), "search")

    def make(batch):
        for query_id, ids, vector, q_vector in batch:
            value = score(vector, q_vector)
            yield from ((query_id, i, value) for i in ids if i != query_id)

    scored = map_partition(read.select("query_id", "ids", "vector", "q_vector"), make, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
