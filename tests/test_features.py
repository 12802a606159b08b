from __future__ import annotations

import math
import os
import random
from datetime import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import workload
from hitframe.operators import features, filters, slabs
from hitframe.plans.coincidence import side_features
from tests.helpers import by_event, by_side, hit, hits


def test_strongest_module_tie_goes_to_the_earliest_hit(spark):
    h = hits(spark, [hit(idx=0, mm=2, energy=3), hit(idx=1, mm=1, energy=5), hit(idx=2, mm=2, energy=2)])
    assert by_side(features.strongest_module(h), "mm", "module_energy") == {(0, 1): (2, 5.0)}


def test_strongest_module_with_all_energies_zero(spark):
    h = hits(spark, [hit(idx=0, mm=3, energy=0), hit(idx=1, mm=1, energy=0)])
    assert by_side(features.strongest_module(h), "mm", "module_energy") == {(0, 1): (3, 0.0)}


def test_only_energy_hits_count_for_the_module(spark):
    h = hits(spark, [hit(idx=0, mm=0, energy=50, kind="time"), hit(idx=1, mm=1, energy=5, kind="energy")])
    assert by_side(features.strongest_module(h), "mm") == {(0, 1): (1,)}
    assert by_side(features.total_energy(h), "energy", "n_energy") == {(0, 1): (5.0, 1)}


def test_strongest_hit_first_wins_and_none(spark):
    h = hits(
        spark,
        [hit(idx=0, energy=4, channel=7), hit(idx=1, energy=4, channel=8), hit(event=1, kind="energy", energy=9)],
    )
    got = {k: v[0] and v[0]["channel"] for k, v in by_side(features.strongest_hit(h, "time"), "hit").items()}
    assert got == {(0, 1): 7, (1, 1): None}


def test_top_hits_are_stable(spark):
    h = hits(spark, [hit(idx=i, energy=e, channel=i) for i, e in enumerate([1, 5, 5, 3])])
    got = [r["channel"] for r in features.top_hits(h, 3).orderBy("rank").collect()]
    assert got == [1, 2, 3]


def test_centroid_by_hand(spark):
    h = hits(spark, [hit(idx=0, energy=1, x=1, y=2), hit(idx=1, energy=3, x=5, y=6)])
    ((cx, cy),) = by_side(features.centroid(h), "cx", "cy").values()
    w = [1.00001, 3.00001]
    assert cx == pytest.approx((w[0] * 1 + w[1] * 5) / sum(w))
    assert cy == pytest.approx((w[0] ** 2 * 2 + w[1] ** 2 * 6) / (w[0] ** 2 + w[1] ** 2))


def test_centroid_on_an_edge_has_the_power_of_the_library(spark):
    h = hits(spark, [hit(idx=0, energy=5, x=1.5, y=10.5), hit(idx=1, energy=5, x=1.5, y=1.5)])
    w = math.pow(5 + features.WEIGHT_OFFSET, 2)
    ((_, cy),) = by_side(features.centroid(h, library_power=True), "cx", "cy").values()
    assert cy == (w * 10.5 + w * 1.5) / (w + w) != by_side(features.centroid(h), "cy")[(0, 1)][0]


def test_region_on_an_edge_is_decided_by_the_order_of_the_table(spark, folder):
    rng, rows = random.Random(5), []
    for event in range(600):  # sides that lie on cy = 6: two pairs of equal energies on both sides of it
        a, b = rng.sample(range(1, 51), 2)
        side = [(event or None, part, n, datetime(2000, 1, 1), "F", float(e)) for n, (part, e) in enumerate([(11, a), (19, a), (11, b), (19, b)])]
        rng.shuffle(side)
        rows.append(side)
    names = ["l_orderkey", "l_partkey", "l_linenumber", "l_shipdate", "l_linestatus", "l_quantity"]
    os.makedirs(f"{folder}/lineitem.parquet")
    for k in range(4):  # a hit of every side in each file
        pq.write_table(pa.table(dict(zip(names, map(list, zip(*(side[k] for side in rows)))))), f"{folder}/lineitem.parquet/{k}.parquet")
    con = duckdb.connect()
    con.sql("SET threads = 1")
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet/*.parquet'")
    wanted = con.sql(workload.ORACLES["f07_region_of_interest"]).fetchall()
    got = workload.QUERIES["f07_region_of_interest"](spark, folder).collect()
    assert sorted(map(tuple, got), key=str) == sorted(wanted, key=str)
    assert 10 < len(wanted) < 590


def test_row_column_centroid_without_one_type(spark):
    h = hits(spark, [hit(kind="time", energy=2, x=3)])
    assert by_side(features.centroid(h, sum_rows_cols=True), "cx", "cy") == {(0, 1): (3.0, None)}
    assert by_side(features.strongest_centroid(h, sum_rows_cols=True), "cx", "cy") == {(0, 1): (3.0, 0.0)}


def test_depth(spark):
    h = hits(
        spark,
        [hit(idx=0, x=1, energy=4), hit(idx=1, x=1, energy=2), hit(idx=2, x=2, energy=3), hit(event=1, energy=0)],
    )
    assert by_side(features.depth_projected(h), "depth") == {(0, 1): (1.5,), (1, 1): (None,)}
    assert by_side(features.depth_single(h), "depth") == {(0, 1): (2.25,), (1, 1): (None,)}
    assert by_side(features.strongest_depth(h), "depth") == {(0, 1): (1.5,), (1, 1): (0.0,)}


def test_impact_cell_last_hit_wins_or_sums(spark):
    h = hits(spark, [hit(idx=0, x=4, y=1, energy=5), hit(idx=1, x=3.5, y=2, energy=2)])
    assert by_side(features.impact_cells(h, 3.0), "row", "col", "energy") == {(0, 1): (0, 1, 2.0)}
    assert by_side(features.impact_cells(h, 3.0, combine="sum"), "energy") == {(0, 1): (7.0,)}
    ((matrix,),) = by_side(features.impact_matrix(features.impact_cells(h, 3.0)), "matrix").values()
    assert matrix[0][1] == 2.0 and sum(map(sum, matrix)) == 2.0 and len(matrix) == len(matrix[0]) == 8


def test_hit_outside_the_matrix_is_an_error(spark):
    cells = features.impact_cells(hits(spark, [hit(x=99)]), 3.0)
    with pytest.raises(Exception, match="outside the impact matrix"):
        features.impact_matrix(cells).collect()


def test_impact_profile_by_hand(spark):
    h = hits(
        spark,
        [hit(event=0, x=0.5, energy=10), hit(event=0, idx=1, x=4, energy=5), hit(event=1, x=0.5, energy=4)],
    )
    cells = features.impact_cells(h, 3.0)
    got = [tuple(r) for r in features.impact_profile(cells, cells, 3).orderBy("rank").collect()]
    assert got == [(1, 1.0, 7.0, 2), (2, 0.25, 7.0, 2), (3, 0.0, 7.0, 2)]


NEIGHBOURS = [(3, 3), (3, 6), (6, 3), (6, 6), (9, 3), (3, 12)]


@pytest.mark.parametrize(
    "mode, axis, wanted",
    [
        (0, "x", {0, 2}),
        (0, "y", {0, 1}),
        (1, "x", {0, 1, 2}),
        (2, "x", {0, 1, 2, 3}),
        (3, "x", {0, 1, 2, 3, 4}),
    ],
)
def test_neighbours(spark, mode, axis, wanted):
    h = hits(spark, [hit(idx=i, channel=i, energy=9 - i, x=x, y=y) for i, (x, y) in enumerate(NEIGHBOURS)])
    got = {r["channel"] for r in features.neighbour_hits(h, mode, 3.0, 3.0, axis).collect()}
    assert got == wanted


def slab_case(event, positions):
    """Time hits at slab positions, strongest first."""
    return [
        hit(event=event, idx=i, energy=9 - i, kind="time", channel=10 * event + i, slab=p, x=p * 3.2 + 1.6)
        for i, p in enumerate(positions)
    ] + [hit(event=event, idx=9, energy=1, kind="energy")]


SLABS = {
    0: ([0, 1], (1, 0)), 1: ([0], (0, 0)), 2: ([7, 6], (14, 0)), 3: ([7], (15, 0)), 4: ([3, 2], (7, 3)),
    5: ([3, 4], (6, 3)), 6: ([3, 5], (None, 2)), 7: ([3, 3], (6, 3)), 8: ([], (None, None)),
}


def test_light_sharing_branches(spark):
    h = hits(spark, [r for event, (p, _) in SLABS.items() for r in slab_case(event, p)])
    got = by_side(slabs.light_sharing_slab(h), "slab", "flag")
    assert got == {(event, 1): wanted for event, (_, wanted) in SLABS.items()}
    scalar = by_side(slabs.light_sharing_slab(h, interior="scalar"), "slab")
    assert scalar[(4, 1)] == (6,) and scalar[(5, 1)] == (7,)
    x = by_side(slabs.light_sharing_slab(h), "slab_x")
    assert x[(0, 1)][0] == pytest.approx(1.6 + 0.8) and x[(2, 1)][0] == pytest.approx(24.0 - 0.8)
    assert x[(4, 1)][0] == pytest.approx(11.2 + 0.8) and x[(5, 1)][0] == pytest.approx(11.2 - 0.8)


def test_lone_interior_hits_split_in_halves_repeatably(spark):
    h = hits(spark, [r for event in range(400) for r in slab_case(event, [4])])
    first = by_side(slabs.light_sharing_slab(h, seed=1), "slab", "flag")
    assert first == by_side(slabs.light_sharing_slab(h.repartition(7), seed=1), "slab", "flag")
    assert {s for s, _ in first.values()} == {8, 9} and {f for _, f in first.values()} == {1}
    assert 120 < sum(s == 8 for s, _ in first.values()) < 280


def test_direct_slab_only_in_the_strongest_module(spark):
    h = hits(
        spark,
        [
            hit(idx=0, mm=0, energy=9, kind="time", channel=1),
            hit(idx=1, mm=1, energy=5, kind="energy", channel=2),
            hit(idx=2, mm=1, energy=3, kind="time", channel=3, time=77),
            hit(event=1, kind="energy"),
        ],
    )
    got = by_side(slabs.direct_slab(h), "slab_channel", "slab_time", "slab_energy")
    assert got == {(0, 1): (3, 77, 3.0), (1, 1): (None, None, None)}


def random_hits(n_events: int, seed: int):
    rng = random.Random(seed)
    rows = []
    for event in range(n_events):
        for side in (1, 2):
            for idx in range(rng.randrange(0, 9)):
                rows.append(
                    hit(event, side, idx, time=rng.randrange(10**6), energy=rng.randrange(1, 6), sm=rng.randrange(2),
                        mm=rng.randrange(3), x=rng.randrange(4) * 3 + 1.5, y=rng.randrange(4) * 3 + 1.5)
                )
    return rows


def test_row_order_and_partitions_do_not_matter(spark):
    rows = random_hits(60, 5)
    one = hits(spark, rows).repartition(1)
    many = hits(spark, random.Random(0).sample(rows, len(rows))).repartition(13)

    def rounded(df):
        # Sums of doubles depend on the order of merging in their last bits.
        return sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect())

    for make in (features.strongest_module, side_features, features.strongest_depth):
        assert rounded(make(one)) == rounded(make(many))


def test_one_pass_features_equal_the_single_ones(spark):
    h = hits(spark, random_hits(60, 6))
    got = by_side(side_features(h), "sm", "mm", "module_energy", "depth", "cx", "n_hits")
    strongest = by_side(features.strongest_module(h), "sm", "mm", "module_energy")
    depth, centre = by_side(features.depth_projected(h), "depth"), by_side(features.centroid(h), "cx")
    counts = by_side(filters.side_counts(h), "n_hits")
    assert set(got) == set(strongest)
    for k, v in got.items():
        assert v[:3] == strongest[k] and v[5] == counts[k][0]
        assert v[3] == pytest.approx(depth[k][0]) and v[4] == pytest.approx(centre[k][0])


def test_filters_on_edges(spark):
    values = spark.createDataFrame([(10.0,), (10.5,), (100.0,)], "e double")
    assert [r["e"] for r in values.filter(filters.energy_window("e", 10, 100)).collect()] == [10.5]
    h = hits(spark, [hit(energy=25), hit(idx=1, energy=24.9)])
    assert filters.hit_threshold(h, 25).count() == 1


def test_channel_list_empty_side_counts_as_all(spark):
    h = hits(
        spark,
        [hit(event=0, channel=1), hit(event=1, channel=9), hit(event=2, channel=9), hit(event=2, side=2, channel=9),
         hit(event=3, channel=1), hit(event=3, idx=1, channel=9), hit(event=3, side=2, channel=9)],
    )
    listed = filters.in_channel_list(h, spark.createDataFrame([(1,), (2,)], "channel int"))
    assert by_event(listed, "listed") == {0: (True,), 1: (True,), 2: (False,), 3: (False,)}


def test_both_sides_and_counts(spark):
    sides = spark.createDataFrame(
        [(0, 0, 1, True), (0, 0, 2, True), (0, 1, 1, True), (0, 2, 1, True), (0, 2, 2, None)],
        "file_id int, event_id bigint, side int, ok boolean",
    )
    passed = filters.both_sides(sides, "ok")
    assert by_event(passed, "passed") == {0: (True,), 1: (False,), 2: (False,)}
    assert tuple(filters.pass_counts(passed, "passed").first()) == (3, 1)
    watched, seen = filters.observed(passed, "passed", "counters")
    watched.write.format("noop").mode("overwrite").save()
    assert seen.get == {"total": 3, "passed": 1}


def test_module_filters(spark):
    h = hits(spark, [hit(mm=0), hit(idx=1, mm=1), hit(side=2, sm=1, mm=0), hit(event=1, mm=0)])
    assert by_side(filters.single_minimodule(h), "single") == {(0, 1): (False,), (0, 2): (True,), (1, 1): (True,)}
    assert by_event(filters.module_span(h), "n_modules") == {0: (3,), 1: (1,)}
    assert by_event(filters.module_span(h, "sm"), "n_modules") == {0: (2,), 1: (1,)}
    assert by_event(filters.touches_module(h, 1, 0), "touches") == {0: (True,), 1: (False,)}


def test_row_column_channel_minimum_needs_another_type(spark):
    h = hits(spark, [hit(kind="energy"), hit(event=1, kind="energy"), hit(event=1, idx=1, kind="time")])
    counts = filters.side_counts(h)
    passed = filters.enough_channels(F.col("n_energy"), F.col("n_hits"), 1, True)
    assert by_side(counts.withColumn("p", passed), "p") == {(0, 1): (False,), (1, 1): (True,)}


def test_impact_matrix_keeps_the_cells_of_a_side_only(spark, capsys):
    h = hits(spark, [hit(idx=0, energy=5, x=0.5, y=0.5), hit(idx=1, energy=7, x=23.5, y=23.5), hit(side=2, energy=2, x=3.5, y=0.5)])
    dense = features.impact_matrix(features.impact_cells(h, 3.0))
    dense.explain()
    plan = capsys.readouterr().out
    assert "collect_list" in plan and plan.count("max(CASE") == 0  # not one aggregate for each of 64 places
    filled = {(s, r, c): v for (_, s), (m,) in by_side(dense, "matrix").items() for r, row in enumerate(m) for c, v in enumerate(row) if v}
    assert filled == {(1, 0, 0): 5.0, (1, 7, 7): 7.0, (2, 0, 1): 2.0}
