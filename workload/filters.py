"""Event predicates and counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from hitframe.operators import features, filters, timing
from workload.fixtures import PLACE, hits, hits_a, hits_b, table, with_views
from workload.registry import query


@query("s06_hit_threshold", with_views("hits", "SELECT event_id, side, hit_idx, energy FROM hits WHERE energy >= 25"))
def s06(spark, sf):
    return filters.hit_threshold(hits(spark, sf), 25).select("event_id", "side", "hit_idx", "energy")


@query(
    "f01_energy_window",
    with_views(
        "ha",
        """SELECT event_id, side, sum(energy) AS energy FROM ha GROUP BY event_id, side
           HAVING sum(energy) > 10 AND sum(energy) < 100""",
    ),
)
def f01(spark, sf):
    sides = features.total_energy(hits_a(spark, sf))
    return sides.filter(filters.energy_window("energy", 10, 100)).select("event_id", "side", "energy")


@query(
    "f01b_energy_window_all_hits",
    with_views(
        "hb",
        """SELECT event_id, side, sum(energy) AS all_energy, sum(energy) > 10 AND sum(energy) < 100 AS passed
           FROM hb GROUP BY event_id, side""",
    ),
)
def f01b(spark, sf):
    sides = filters.side_counts(hits_b(spark, sf))
    return sides.select("event_id", "side", "all_energy", filters.energy_window("all_energy").alias("passed"))


@query(
    "f02_min_channels",
    with_views(
        "ha",
        """SELECT event_id, side, count(*) FILTER (WHERE is_energy) AS n_energy,
                  count(*) FILTER (WHERE is_energy) >= 2 AS passed
           FROM ha GROUP BY event_id, side""",
    ),
)
def f02(spark, sf):
    sides = filters.side_counts(hits_a(spark, sf))
    passed = filters.enough_channels(F.col("n_energy"), F.col("n_hits"), 2)
    return sides.select("event_id", "side", "n_energy", passed.alias("passed"))


@query(
    "f02_min_channels_rowcol",
    with_views(
        "hb",
        """SELECT event_id, side, count(*) AS n_hits, count(*) FILTER (WHERE is_energy) AS n_energy,
                  count(*) FILTER (WHERE is_energy) >= 1 AND count(*) FILTER (WHERE is_energy) < count(*) AS passed
           FROM hb GROUP BY event_id, side""",
    ),
)
def f02_rowcol(spark, sf):
    sides = filters.side_counts(hits_b(spark, sf))
    passed = filters.enough_channels(F.col("n_energy"), F.col("n_hits"), 1, sum_rows_cols=True)
    return sides.select("event_id", "side", "n_hits", "n_energy", passed.alias("passed"))


@query(
    "f03_single_minimodule",
    with_views("ha", "SELECT event_id, side, count(DISTINCT mm_id) = 1 AS single FROM ha GROUP BY event_id, side"),
)
def f03(spark, sf):
    return filters.single_minimodule(hits_a(spark, sf)).select("event_id", "side", "single")


@query(
    "f04_max_modules",
    with_views(
        "ha",
        """SELECT event_id, count(DISTINCT mm_id) AS n_modules, count(DISTINCT mm_id) <= 2 AS passed
           FROM ha GROUP BY event_id""",
    ),
)
def f04(spark, sf):
    span = filters.module_span(hits_a(spark, sf))
    return span.select("event_id", "n_modules", (F.col("n_modules") <= 2).alias("passed"))


@query(
    "f04_max_supermodules",
    with_views("ha", "SELECT event_id, count(DISTINCT sm) AS n_modules FROM ha GROUP BY event_id"),
)
def f04_sm(spark, sf):
    return filters.module_span(hits_a(spark, sf), level="sm").select("event_id", "n_modules")


@query(
    "f05_touches_module",
    with_views("ha", "SELECT event_id, bool_or(sm = 1 AND mm = 0) AS touches FROM ha GROUP BY event_id"),
)
def f05(spark, sf):
    return filters.touches_module(hits_a(spark, sf), 1, 0).select("event_id", "touches")


@query(
    "f05_touches_any_module",
    with_views(
        "hb",
        """SELECT DISTINCT event_id FROM hb
           WHERE (sm, mm) IN (SELECT (n_regionkey, n_nationkey) FROM nation)""",
    ),
)
def f05_any(spark, sf):
    n = table(spark, sf, "nation")
    modules = n.select(F.col("n_regionkey").alias("sm"), F.col("n_nationkey").alias("mm"))
    return filters.touching_any(hits_b(spark, sf), modules).select("event_id")


@query(
    "f06_channel_list",
    with_views(
        "hits",
        """, m AS (SELECT event_id, side, channel IN (SELECT s_suppkey FROM supplier) AS listed FROM hits)
           SELECT event_id, coalesce(bool_and(listed) FILTER (WHERE side = 1), true)
                         OR coalesce(bool_and(listed) FILTER (WHERE side = 2), true) AS listed
           FROM m GROUP BY event_id""",
    ),
)
def f06(spark, sf):
    channels = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("int").alias("channel"))
    return filters.in_channel_list(hits(spark, sf), channels).select("event_id", "listed")


@query(
    "f07_region_of_interest",
    with_views(
        "ha",
        """, c AS (SELECT event_id, side, sum((energy + 0.00001::DOUBLE) * x) / sum(energy + 0.00001::DOUBLE) AS cx,
                          sum(pow(energy + 0.00001::DOUBLE, 2) * y) / sum(pow(energy + 0.00001::DOUBLE, 2)) AS cy
                   FROM ha GROUP BY event_id, side)
           SELECT event_id, side, round(cx, 6) AS cx, round(cy, 6) AS cy FROM c
           WHERE cx > 5 AND cx < 15 AND cy > 6 AND cy < 18""",
    ),
)
def f07(spark, sf):
    x_range, y_range = (5, 15), (6, 18)
    c = features.ordered_centroid(hits_a(spark, sf, placed=True), PLACE, x_range, y_range, 6)
    inside = c.filter(filters.region_of_interest("cx", "cy", x_range, y_range))
    return inside.select("event_id", "side", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


COINCIDENCE_WINDOW = 50_000_000_000


@query(
    "f08_coincidence_window",
    with_views(
        "hb",
        f""", t AS (SELECT * FROM hb WHERE is_time QUALIFY row_number() OVER (
                      PARTITION BY event_id, side ORDER BY energy DESC, hit_idx) = 1),
              p AS (SELECT event_id, max(time) FILTER (WHERE side = 1) AS time1,
                           max(time) FILTER (WHERE side = 2) AS time2,
                           max(channel) FILTER (WHERE side = 1) AS channel1,
                           max(channel) FILTER (WHERE side = 2) AS channel2 FROM t GROUP BY event_id)
            SELECT e.event_id, time1, time2, channel1, channel2,
                   coalesce(abs(time1 - time2) < {COINCIDENCE_WINDOW}, false) AS coincident
            FROM (SELECT DISTINCT event_id FROM hb) e LEFT JOIN p USING (event_id)""",
    ),
)
def f08(spark, sf):
    c = timing.coincidence(hits_b(spark, sf), COINCIDENCE_WINDOW)
    return c.select(
        "event_id",
        F.col("hit1.time").alias("time1"),
        F.col("hit2.time").alias("time2"),
        F.col("hit1.channel").alias("channel1"),
        F.col("hit2.channel").alias("channel2"),
        "coincident",
    )


BOTH_SQL = """, s AS (SELECT file_id, event_id, side, module_energy > 10 AND module_energy < 100 AS ok FROM best_a),
  b AS (SELECT event_id, coalesce(bool_or(ok) FILTER (WHERE side = 1), false)
                     AND coalesce(bool_or(ok) FILTER (WHERE side = 2), false) AS passed FROM s GROUP BY event_id)
"""


@query("f09_both_sides", with_views("best_a", BOTH_SQL + "SELECT event_id, passed FROM b"))
def f09(spark, sf):
    sides = features.strongest_module(hits_a(spark, sf))
    return filters.both_sides(sides, filters.energy_window("module_energy")).select("event_id", "passed")


@query(
    "f10_pass_counts",
    with_views(
        "best_a", BOTH_SQL + "SELECT count(*) AS total, count(*) FILTER (WHERE passed) AS passed FROM b"
    ),
)
def f10(spark, sf):
    sides = features.strongest_module(hits_a(spark, sf))
    return filters.pass_counts(filters.both_sides(sides, filters.energy_window("module_energy")), "passed")
