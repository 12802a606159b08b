from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from hitframe.operators import lookups, timing
from tests.helpers import by_event, hit, hits

BIG = 1 << 60


def skews(spark, rows):
    return spark.createDataFrame(rows, "channel int, skew double")


def test_skew_keeps_large_times_exact(spark):
    h = hits(spark, [hit(time=BIG + 5, channel=1), hit(idx=1, time=BIG, channel=1, kind="energy")])
    got = timing.apply_skew(h, skews(spark, [(1, 2.25)])).orderBy("hit_idx").collect()
    assert got[0]["time"] == BIG + 2 and got[0]["time_fraction"] == pytest.approx(0.75)
    assert got[1]["time"] == BIG and got[1]["time_fraction"] == 0
    none = timing.apply_skew(h, skews(spark, [(9, 2.25)])).orderBy("hit_idx").first()
    assert none["time"] == BIG + 5


def test_first_time_hits(spark):
    h = hits(
        spark,
        [hit(idx=0, time=99, kind="energy"), hit(idx=1, time=BIG + 7), hit(idx=2, time=BIG), hit(side=2, time=BIG + 3),
         hit(event=1, time=5)],
    )
    assert by_event(timing.dt_first(h), "dt") == {0: (4,), 1: (None,)}


def test_weighted_times_clamp_and_keep_precision(spark):
    h = hits(
        spark,
        [hit(idx=0, time=BIG + 10, energy=1), hit(idx=1, time=BIG + 20, energy=3), hit(side=2, time=BIG + 4, energy=2)],
    )
    assert by_event(timing.dt_weighted(h, 9, 9), "dt")[0][0] == pytest.approx(17.5 - 4)
    assert by_event(timing.dt_weighted(h, 1, 1), "dt")[0][0] == pytest.approx(6)
    with pytest.raises(ValueError):
        timing.dt_weighted(h, 0, 1)


def test_nth_timestamp_clamps_to_the_last(spark):
    h = hits(
        spark,
        [hit(idx=0, time=10, energy=1), hit(idx=1, time=20, energy=2, channel=5), hit(side=2, time=3, energy=7),
         hit(event=1, time=1)],
    )
    got = by_event(timing.dt_nth(h, skews(spark, [(5, 0.5)]), 4, 1), "dt", "energy1", "energy2")
    assert got == {0: (16.5, 2.0, 7.0), 1: (None, 1.0, None)}


def test_sort_by_time_is_stable(spark):
    h = hits(spark, [hit(idx=0, time=5, channel=0), hit(idx=1, time=3, channel=1), hit(idx=2, time=3, channel=2)])
    got = [r["channel"] for r in timing.sort_by_time(h).orderBy("hit_idx").collect()]
    assert got == [1, 2, 0]


@pytest.mark.parametrize("slices", [1, 3, 1024])
def test_sliced_sort_of_overlong_sides_is_exact(spark, slices):
    rng = random.Random(slices)
    rows = [hit(event=e, idx=i, time=BIG + rng.randrange(40), channel=i) for e, n in ((0, 300), (1, 8)) for i in range(n)]
    h = hits(spark, rng.sample(rows, len(rows)))
    overlong = timing.overlong_sides(h, longest=20)
    assert [r["event_id"] for r in overlong.collect()] == [0]
    plain = {(r["event_id"], r["hit_idx"]): r["channel"] for r in timing.sort_by_time(h).collect()}
    sliced = timing.sort_by_time(h, overlong, 1, slices)
    assert sliced.columns == h.columns
    assert {(r["event_id"], r["hit_idx"]): r["channel"] for r in sliced.collect()} == plain


@pytest.mark.parametrize("every, cuts", [(1, 1), (1, 5000), (2, 7), (3, 1000), (4096, 2048)])
def test_numbering_by_time_is_exact_for_bursts_and_any_size(spark, every, cuts):
    rng = random.Random(every)
    times = {0: lambda: BIG, 1: lambda: BIG + rng.randrange(40), 2: lambda: rng.getrandbits(60), 3: lambda: rng.choice([7, 7, 7, 9])}
    rows = [hit(event=e, side=s, idx=i, time=times[e](), channel=i) for e in times for s, n in ((1, 400), (2, e)) for i in range(n)]
    h = hits(spark, rng.sample(rows, len(rows)))
    got = timing.number_by_time(h, every, cuts)
    assert got.columns == h.columns
    key = lambda r: (r["event_id"], r["side"], r["channel"])
    plain = {key(r): r["hit_idx"] for r in timing.sort_by_time(h).collect()}
    assert {key(r): r["hit_idx"] for r in got.collect()} == plain and len(plain) == len(rows)


def test_numbering_starts_no_job_and_spreads_a_burst(spark):
    h = hits(spark, [hit(idx=i, time=BIG, channel=i) for i in range(4000)])
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    out = timing.number_by_time(h, every=50)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == before
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.sum("hit_idx")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(parts) == 4 and max(r["n"] for r in parts) < 2200
    assert sorted(r["hit_idx"] for r in out.collect()) == list(range(4000))


def test_coincidence_window_is_strict(spark):
    h = hits(
        spark,
        [hit(idx=0, time=100, energy=1), hit(idx=1, time=10, energy=5), hit(side=2, time=20), hit(event=1, time=1)],
    )
    assert by_event(timing.coincidence(h, 10), "coincident") == {0: (False,), 1: (False,)}
    assert by_event(timing.coincidence(h, 11), "coincident") == {0: (True,), 1: (False,)}


def test_unmapped_channels_drop_keep_fail(spark):
    h = spark.createDataFrame([(1, 5), (2, 6)], "event_id int, channel int")
    dim = spark.createDataFrame([(5, 0)], "channel int, sm int")
    assert lookups.with_channels(h, dim, "drop").count() == 1
    with pytest.raises(Exception, match="no entry"):
        lookups.with_channels(h, dim).collect()
    assert lookups.with_channels(h, dim, "keep").count() == 2
    with pytest.raises(Exception, match="no entry for channel = 6"):
        lookups.with_channels(h, dim, "fail").collect()
    assert lookups.with_channels(h.filter("channel = 5"), dim, "fail", rows=1).count() == 1
    assert [tuple(r) for r in lookups.unmapped_channels(h, dim).collect()] == [(6, 1)]
