"""Groups that no single member holds together, against comparing all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from hitframe.llm import ngram_join
from tests.llm.brute import components, shingles


def chains(seed: int, groups: int = 4, members: int = 40) -> list[tuple[int, str]]:
    """Texts around a passage that all have: each group drifts away from its first text, so that only neighbours are similar."""
    rng = np.random.default_rng(seed)
    rows, passage = [], " ".join(f"p{i}" for i in range(40))
    for g in range(groups):
        words = [f"g{g}w{i}" for i in range(60)]
        for m in range(members):
            if m:
                for _ in range(int(rng.integers(0, 3))):
                    words[int(rng.integers(0, len(words)))] = f"g{g}m{m}x{int(rng.integers(0, 9))}"
            rows.append((1 + int(rng.integers(0, 10**9)), f"{passage} {' '.join(words)}"))
    return rows


@pytest.mark.parametrize("block,codes", [(512, 1 << 17), (7, 1 << 17), (512, 400)])
def test_open_groups_equal_brute_force(spark, monkeypatch, block, codes):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "BLOCK_CODES", codes)
    rows = chains(block + codes)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    own = ngram_join.written(ngram_join.sketches(docs), "sketches")
    sets = own.where("keys IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    links = ngram_join.Links(docs, sets)
    # the same group by two keys, and a group of a single set
    members = sets.select("set_id", F.explode(F.array(F.lit(5), F.lit(9))).alias("key")).unionByName(sets.limit(1).select("set_id", F.lit(3).alias("key")))
    links.join_within(members.select(F.col("key").cast("long").alias("key"), "set_id"), docs)
    named = own.join(links.labels, own["set_id"] == links.labels["node"], "left").select("doc_id", F.coalesce("comp", "set_id").alias("comp")).collect()
    smallest: dict = {}
    for r in named:
        smallest[r["comp"]] = min(r["doc_id"], smallest.get(r["comp"], r["doc_id"]))
    wanted = components({d: shingles(t) for d, t in rows})
    assert {r["doc_id"]: smallest[r["comp"]] for r in named} == wanted and 1 < len(set(wanted.values())) < len(rows)
    assert links.edges.count() < 2 * len(rows)


def test_texts_with_one_passage_equal_brute_force(spark):
    rows = chains(1, 3, 20)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(docs, 2).collect()}
    assert got == components({d: shingles(t) for d, t in rows})


def test_blocks_give_a_spanning_forest():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 300).astype(np.uint64)
    sets = [np.sort(rng.choice(base, 290, replace=False)) for _ in range(50)]
    pack = lambda own: tuple(np.array(c, np.int64).tobytes() for c in (own, own, [len(sets[i]) for i in own])) + (b"".join(sets[i].tobytes() for i in own),)
    alone = list(ngram_join.compare_blocks(iter([(*pack(range(50)), None, None, None, None)])))
    assert len(alone) == 49 and all(a < b for a, b in alone)
    assert len(list(ngram_join.compare_blocks(iter([pack(range(20)) + pack(range(20, 50))])))) == 49
