"""Whole analyses, result tables, and the shape of physical plans."""

from __future__ import annotations

import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from hitframe.functions import nested
from hitframe.functions.nested import ChannelArrays
from hitframe.maps import configured_channel_map
from hitframe.maps.config import validated
from hitframe.operators import features, filters, timing
from hitframe.operators.inference import predict_positions
from hitframe.operators.lookups import small_side, with_channels
from hitframe.plans import coincidence
from hitframe.schema import EVENT, MAX_BROADCAST_ROWS
from hitframe.session import checkpointed, scratch_path, shared_dir
from hitframe.sinks import tables as sinks
from hitframe.sources.events import to_hits
from hitframe.streaming.ingest import append_to_table, landing_events
from tests.conftest import SF
from tests.helpers import by_side, hit, hits
from workload.dimensions import SUM_LISTS
from workload.files import FIXTURE_MAP, written
from workload.fixtures import hits_a, hits_b


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df) -> list[str]:
    return re.findall(r"(?<!Broadcast)Exchange hashpartitioning\((.*?), \d+\)", plan(df))


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.format("fixed_events").load(written(spark, SF, "fixed")).cache()


def test_flagship_moves_hits_twice_and_looks_channels_up_by_broadcast(spark):
    df = coincidence.coincidence_modules(hits_a(spark, SF))
    by_event = [e for e in exchanges(df) if "event_id" in e]
    assert len(by_event) == 2 and len(exchanges(df)) == 3
    assert "BroadcastHashJoin" in plan(df) and "SortMergeJoin" not in plan(df)
    assert "Python" not in plan(df)


def test_scan_reads_only_the_needed_columns(spark):
    df = features.total_energy(hits_b(spark, SF))
    schema = re.search(r"ReadSchema: struct<(.*?)>", plan(df)).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"l_orderkey", "l_partkey", "l_quantity", "l_linestatus"}


def test_nested_path_shuffles_only_module_sums(spark, events):
    df = coincidence.coincidence_modules_nested(events, ChannelArrays.of(FIXTURE_MAP))
    assert len(exchanges(df)) == 1 and "event_id" not in exchanges(df)[0]


def test_bucketed_hits_need_no_shuffle_per_event(spark):
    sinks.store_hits(hits_a(spark, SF), "bucketed_hits", buckets=4)
    df = features.strongest_module(spark.table("bucketed_hits"))
    assert exchanges(df) == []
    assert df.count() == features.strongest_module(hits_a(spark, SF)).count()
    placed = coincidence.side_features(spark.table("bucketed_hits"), placed=True)
    assert exchanges(placed) == [] and placed.count() == df.count()
    spark.sql("DROP TABLE bucketed_hits")


def test_rank_limit_is_applied_before_the_shuffle(spark):
    assert plan(features.top_hits(hits_b(spark, SF), 2)).count("WindowGroupLimit") == 2


def test_broadcast_hint_depends_on_the_proven_size(spark):
    def hinted(rows):
        return "broadcast" in small_side(spark.range(5), rows)._jdf.queryExecution().toString().lower()

    assert hinted(5) and not hinted(None) and not hinted(MAX_BROADCAST_ROWS + 1)


def test_nested_features_equal_the_long_ones(spark, events):
    config = FIXTURE_MAP
    featured = nested.with_features(events, ChannelArrays.of(config))
    long = with_channels(to_hits(events), configured_channel_map(spark, config))
    keyed = {
        (r["file_id"], r["event_id"], r["side"]): r for r in coincidence.side_features(long).collect()
    }
    assert len(keyed) > 2000
    seen = 0
    singles = {(r["file_id"], r["event_id"], r["side"]): r["single"] for r in filters.single_minimodule(long).collect()}
    strongest = features.strongest_hit(long, "time").collect()
    times = {(r["file_id"], r["event_id"], r["side"]): r["hit"]["time"] for r in strongest}
    for r in featured.select(*EVENT, "f1", "f2").collect():
        for side in (1, 2):
            f, key = r[f"f{side}"], (r["file_id"], r["event_id"], side)
            if f["n_hits"] == 0:
                assert f["mm_id"] is None
                continue
            seen += 1
            w = keyed[key]
            assert (f["n_hits"], f["energy"], f["module_energy"]) == (w["n_hits"], w["energy"], w["module_energy"])
            assert f["mm_id"] == w["sm"] * 1000 + w["mm"]
            for c in ("cx", "cy", "depth"):
                assert f[c] == pytest.approx(w[c])
            assert f["single"] == singles[key] and f["time"] == times[key]
    assert seen == len(keyed)


def test_nested_row_column_features_equal_the_long_ones(spark, events):
    config = validated(
        {
            "FEM": "FEM256", "FEBD": "none", "mod_feb_map": {4: [0, 0, 0]}, "x_pitch": 3.0, "y_pitch": 3.0,
            "mM_channels": 8, "sum_rows_cols": True, "Time": SUM_LISTS[0], "Energy": SUM_LISTS[1],
        }
    )
    long = with_channels(to_hits(events), configured_channel_map(spark, config))
    joined = features.centroid(long, sum_rows_cols=True).join(features.depth_single(long), ["event_id", "file_id", "side"])
    joined = joined.join(features.strongest_module(long), ["event_id", "file_id", "side"])
    wanted = {(r["file_id"], r["event_id"], r["side"]): r for r in joined.collect()}
    featured = nested.with_features(events, ChannelArrays.of(config), sum_rows_cols=True)
    seen = 0
    for r in featured.select(*EVENT, "f1", "f2").collect():
        for side in (1, 2):
            f = r[f"f{side}"]
            if f["n_hits"]:
                w = wanted[(r["file_id"], r["event_id"], side)]
                assert (f["mm_id"], f["module_energy"]) == (4000 + w["mm"], w["module_energy"])
                for c in ("cx", "cy", "depth"):
                    assert f[c] == (w[c] if w[c] is None else pytest.approx(w[c]))
                seen += 1
    assert seen == len(wanted) > 2000


def test_nested_unmapped_channels(spark):
    arrays = ChannelArrays.of(FIXTURE_MAP)
    hit_type = "array<struct<time:bigint,energy:float,channel:int>>"
    row = spark.createDataFrame([([(1, 1.0, c) for c in (3, 255, 256, -1)],)], f"side1 {hit_type}")
    assert len(row.select(arrays.enrich("side1", "drop")).first()[0]) == 2
    assert [h["mm_id"] for h in row.select(arrays.enrich("side1", "keep")).first()[0]] == [0, 1001, None, None]
    with pytest.raises(Exception, match="not in the map"):
        row.select(arrays.enrich("side1", "fail")).collect()


def test_nested_time_order_and_first_hit(spark, events):
    arrays = ChannelArrays.of(FIXTURE_MAP)
    side = events.select("event_id", arrays.enrich("side1").alias("h"))
    got = side.select(nested.sort_by_time(F.col("h")).alias("s"), nested.first_time_hit(F.col("h")).alias("first"), "h")
    for r in got.limit(200).collect():
        assert [h["time"] for h in r["s"]] == sorted(h["time"] for h in r["h"])
        assert r["first"] == (r["h"][0] if r["h"] else None)


def test_features_of_a_stream_equal_those_of_the_batch(spark, folder):
    """Everything per event is stateless on the nested form, so it runs in append mode as it is."""
    path, arrays = written(spark, SF, "fixed"), ChannelArrays.of(FIXTURE_MAP)

    def featured(events):
        kept = nested.with_features(events, arrays).filter(F.col("f1.n_energy") >= 2)
        return kept.select("file_name", "event_id", "f1.energy", "f1.mm_id", "f2.time")

    stream = featured(landing_events(spark, path, max_files_per_trigger=1))
    append_to_table(stream, f"{folder}/out", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    batch = featured(spark.read.format("fixed_events").load(path))
    assert sorted(spark.read.parquet(f"{folder}/out").collect()) == sorted(batch.collect())


def test_light_spread(spark):
    h = hits_a(spark, SF)
    pairs = checkpointed(coincidence.passing_pairs(h, 1))
    out = coincidence.light_spread(h, pairs, 3.0)
    window = out["window"].first()
    assert window["problem"] is None or window["mu"] is None
    both = {(r["event_id"]) for r in pairs.collect()}
    n = filters.side_counts(h).filter("n_energy >= 1").groupBy(*EVENT).count().filter("count = 2").count()
    assert len(both) == n == pairs.count()
    if window["mu"] is not None:
        inside = [r for r in pairs.collect() if window["peak_low"] < r["f1"]["energy"] < window["peak_high"]]
        assert out["profile"].first()["n_events"] == len(inside)
        assert out["flood"].agg(F.sum("count_passed")).first()[0] == len(inside)


def test_training_table_ignores_same_numbered_modules_elsewhere(spark):
    h = hits(spark, [hit(idx=0, sm=0, mm=1, energy=9, x=1.5, y=4.5), hit(idx=1, sm=1, mm=1, energy=2, x=1.5, y=1.5)])
    columns = ("col_0", "col_1", "row_0", "mm", "sm")
    assert by_side(sinks.training_table(h, 3.0), *columns) == {(0, 1): (0.0, 9.0, 9.0, 1, 0)}
    assert by_side(sinks.training_table(h, 3.0, parity=True), *columns) == {(0, 1): (2.0, 9.0, 11.0, 1, 0)}


def lines_of(path):
    names = sorted(n for n in os.listdir(path) if n.startswith("part-"))
    return [line for n in names for line in open(os.path.join(path, n)).read().splitlines()]


def test_text_outputs(spark, folder):
    h = hits(spark, [hit(energy=9.126, x=1.5, y=4.5)])
    sinks.write_training_text(sinks.training_table(h, 3.0), f"{folder}/nn")
    (line,) = lines_of(f"{folder}/nn")
    fields = line.split("\t")
    assert len(fields) == 18 and fields[1] == fields[8] == "9.13" and fields[16:] == ["0", "0"]
    cells = features.impact_cells(h, 3.0)
    sinks.write_profile(features.impact_profile(cells, cells, 64), f"{folder}/profile")
    lines = lines_of(f"{folder}/profile")
    assert len(lines) == 65 and lines[:3] == ["9.126", "1.0", "0.0"]


def test_listmode_ranges(spark):
    names = [n for n, _ in sinks.LISTMODE["V5"]]
    row = dict.fromkeys(names, 1.0)
    good = spark.createDataFrame([row]).select(*names)
    assert [t for _, t in sinks.listmode_table(good, "V5").dtypes] == [
        "float", "int", "int", "float", "tinyint", "tinyint", "tinyint", "tinyint", "tinyint", "tinyint", "int", "smallint",
    ]
    bad = good.withColumn("xPosition1", F.lit(200.0))
    with pytest.raises(Exception, match="xPosition1 does not fit: 200.0"):
        sinks.listmode_table(bad, "V3").collect()
    assert sinks.listmode_table(bad, "V3", outside="null").first()["xPosition1"] is None
    with pytest.raises(ValueError):
        sinks.listmode_header(good, F.lit(True), nonsense=1)


def test_inference_loads_once_per_task_and_defaults_categories(spark):
    def load():
        return lambda cat_y, signals, cat_depth: (signals.sum(axis=1) + cat_y, None)

    rows = spark.range(100).select("id", F.array(*[F.col("id").cast("double")] * 16).alias("signals"))
    got = predict_positions(rows, load).orderBy("id").collect()
    assert [r["local_y"] for r in got] == [16.0 * i for i in range(100)]
    assert all(r["depth"] is None or np.isnan(r["depth"]) for r in got)


def test_shared_folder_is_the_configured_one(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_dir(spark) == (configured or spark.sparkContext.getCheckpointDir())
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_one_event_with_a_third_of_all_hits(spark):
    """Results stay whole and equal when a single event holds a third of the rows."""
    base = hits_a(spark, SF)
    hot = base.withColumn("event_id", F.when(F.col("event_id") % 3 == 0, F.lit(-1)).otherwise(F.col("event_id")))
    sides = {(r["event_id"], r["side"]): r for r in coincidence.side_features(hot).collect()}
    wanted = hot.filter("event_id = -1 and side = 1").agg(F.count("*"), F.sum("energy")).first()
    assert tuple(wanted) == (sides[(-1, 1)]["n_hits"], sides[(-1, 1)]["energy"])
    top = features.top_hits(hot, 3).filter("event_id = -1 and side = 1").orderBy("rank").collect()
    best = hot.filter("event_id = -1 and side = 1").orderBy(F.desc("energy"), "hit_idx").limit(3).collect()
    assert [r["channel"] for r in top] == [r["channel"] for r in best]
    assert timing.dt_first(hot).count() == hot.select("event_id").distinct().count()
