"""Per-event features."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hitframe.operators import features, filters, slabs
from hitframe.schema import EVENT
from workload.fixtures import hits_a, hits_b, with_views
from workload.registry import query


def r6(name: str, alias: str | None = None):
    return F.round(name, 6).alias(alias or name)


@query(
    "a01_total_energy",
    with_views(
        "hb",
        """SELECT event_id, side, coalesce(sum(energy) FILTER (WHERE is_energy), 0) AS energy
           FROM hb GROUP BY event_id, side""",
    ),
)
def a01(spark, sf):
    return features.total_energy(hits_b(spark, sf)).select("event_id", "side", "energy")


@query(
    "a02_energy_channels",
    with_views(
        "hb",
        "SELECT event_id, side, count(*) FILTER (WHERE is_energy) AS n_energy FROM hb GROUP BY event_id, side",
    ),
)
def a02(spark, sf):
    return features.total_energy(hits_b(spark, sf)).select("event_id", "side", "n_energy")


@query("a03_strongest_module", with_views("best_a", "SELECT event_id, side, sm, mm, module_energy FROM best_a"))
def a03(spark, sf):
    return features.strongest_module(hits_a(spark, sf)).select("event_id", "side", "sm", "mm", "module_energy")


@query(
    "a03_strongest_module_hits",
    with_views("hs_b", "SELECT event_id, side, hit_idx, channel, energy, mm, module_energy FROM hs_b"),
)
def a03_hits(spark, sf):
    out = features.strongest_module_hits(hits_b(spark, sf))
    return out.select("event_id", "side", "hit_idx", "channel", "energy", "mm", "module_energy")


@query(
    "a04_top_hits",
    with_views(
        "hb",
        """SELECT event_id, side, hit_idx, channel, energy,
                  CAST(row_number() OVER (PARTITION BY event_id, side ORDER BY energy DESC, hit_idx) AS INTEGER) AS rank
           FROM hb WHERE is_energy QUALIFY rank <= 2""",
    ),
)
def a04(spark, sf):
    out = features.top_hits(hits_b(spark, sf), 2)
    return out.select("event_id", "side", "hit_idx", "channel", "energy", "rank")


@query(
    "a05_strongest_hit",
    with_views(
        "hb",
        """, t AS (SELECT * FROM hb WHERE is_time QUALIFY row_number() OVER (
                     PARTITION BY event_id, side ORDER BY energy DESC, hit_idx) = 1)
           SELECT s.event_id, s.side, t.time, t.energy, t.channel
           FROM (SELECT DISTINCT event_id, side FROM hb) s LEFT JOIN t USING (event_id, side)""",
    ),
)
def a05(spark, sf):
    out = features.strongest_hit(hits_b(spark, sf), "time")
    return out.select("event_id", "side", "hit.time", "hit.energy", "hit.channel")


@query(
    "a05_strongest_hit_any_type",
    with_views(
        "hb",
        """SELECT event_id, side, time, energy, channel FROM hb QUALIFY row_number() OVER (
             PARTITION BY event_id, side ORDER BY energy DESC, hit_idx) = 1""",
    ),
)
def a05_any(spark, sf):
    out = features.strongest_hit(hits_b(spark, sf))
    return out.select("event_id", "side", "hit.time", "hit.energy", "hit.channel")


STRONGEST_TIME_SQL = """, t AS (SELECT * FROM hs_b WHERE is_time QUALIFY row_number() OVER (
  PARTITION BY event_id, side ORDER BY energy DESC, hit_idx) = 1)
"""


@query(
    "a06_module_time",
    with_views(
        "hs_b",
        STRONGEST_TIME_SQL
        + """SELECT b.event_id, b.side, b.mm, coalesce(t.time, -1) AS module_time
             FROM best_b b LEFT JOIN t USING (event_id, side)""",
    ),
)
def a06(spark, sf):
    h = hits_b(spark, sf)
    out = features.module_time(h, features.strongest_module(h))
    return out.select("event_id", "side", "mm", F.coalesce("module_time", F.lit(-1)).alias("module_time"))


def centroid_sql(source: str, where_x: str = "true", where_y: str = "true", zero: bool = False) -> str:
    w, w2 = "(energy + 0.00001::DOUBLE)", "pow(energy + 0.00001::DOUBLE, 2)"
    cx = f"sum({w} * x) FILTER (WHERE {where_x}) / sum({w}) FILTER (WHERE {where_x})"
    cy = f"sum({w2} * y) FILTER (WHERE {where_y}) / sum({w2}) FILTER (WHERE {where_y})"
    if zero:
        cx, cy = f"coalesce({cx}, 0)", f"coalesce({cy}, 0)"
    return f"""SELECT event_id, side, round({cx}, 6) AS cx, round({cy}, 6) AS cy
               FROM {source} GROUP BY event_id, side"""


@query("a07_centroid", with_views("ha", centroid_sql("ha")))
def a07(spark, sf):
    return features.centroid(hits_a(spark, sf)).select("event_id", "side", r6("cx"), r6("cy"))


@query("a08_centroid_rowcol", with_views("hb", centroid_sql("hb", "is_time", "is_energy")))
def a08(spark, sf):
    out = features.centroid(hits_b(spark, sf), sum_rows_cols=True)
    return out.select("event_id", "side", r6("cx"), r6("cy"))


@query("a09_strongest_centroid", with_views("hs_a", centroid_sql("hs_a", zero=True)))
def a09(spark, sf):
    return features.strongest_centroid(hits_a(spark, sf)).select("event_id", "side", r6("cx"), r6("cy"))


@query("a09_strongest_centroid_rowcol", with_views("hs_b", centroid_sql("hs_b", "is_time", "is_energy", True)))
def a09_rowcol(spark, sf):
    out = features.strongest_centroid(hits_b(spark, sf), sum_rows_cols=True)
    return out.select("event_id", "side", r6("cx"), r6("cy"))


@query(
    "a10_depth_rowcol",
    with_views(
        "hb",
        """SELECT event_id, side, round(sum(energy) FILTER (WHERE is_energy)
                                        / max(energy) FILTER (WHERE is_energy), 6) AS depth
           FROM hb GROUP BY event_id, side""",
    ),
)
def a10(spark, sf):
    return features.depth_single(hits_b(spark, sf)).select("event_id", "side", r6("depth"))


@query(
    "a11_depth_projected",
    with_views(
        "ha",
        """, l AS (SELECT event_id, side, x, sum(energy) AS e FROM ha GROUP BY event_id, side, x)
           SELECT event_id, side, round(sum(e) / max(e), 6) AS depth FROM l GROUP BY event_id, side""",
    ),
)
def a11(spark, sf):
    return features.depth_projected(hits_a(spark, sf)).select("event_id", "side", r6("depth"))


@query(
    "a11_depth_projected_y",
    with_views(
        "ha",
        """, l AS (SELECT event_id, side, y, sum(energy) AS e FROM ha GROUP BY event_id, side, y)
           SELECT event_id, side, round(sum(e) / max(e), 6) AS depth FROM l GROUP BY event_id, side""",
    ),
)
def a11_y(spark, sf):
    return features.depth_projected(hits_a(spark, sf), "y").select("event_id", "side", r6("depth"))


@query(
    "a12_strongest_depth",
    with_views(
        "hs_a",
        """, l AS (SELECT event_id, side, x, sum(energy) AS e FROM hs_a WHERE is_energy GROUP BY event_id, side, x)
           SELECT event_id, side, round(sum(e) / max(e), 6) AS depth FROM l GROUP BY event_id, side""",
    ),
)
def a12(spark, sf):
    return features.strongest_depth(hits_a(spark, sf)).select("event_id", "side", r6("depth"))


@query(
    "a12_strongest_depth_rowcol",
    with_views(
        "hs_b",
        """SELECT event_id, side, round(coalesce(sum(energy) FILTER (WHERE is_energy)
                                                 / max(energy) FILTER (WHERE is_energy), 0), 6) AS depth
           FROM hs_b GROUP BY event_id, side""",
    ),
)
def a12_rowcol(spark, sf):
    out = features.strongest_depth(hits_b(spark, sf), sum_rows_cols=True)
    return out.select("event_id", "side", r6("depth"))


CELLS_SQL = """, cells AS (
  SELECT file_id, event_id, side, CAST(floor(y / 3) AS INTEGER) AS row, CAST(floor(x / 3) AS INTEGER) AS col,
         {value} AS energy
  FROM ha GROUP BY ALL)
"""
LAST_CELLS_SQL = CELLS_SQL.format(value="max_by(energy, hit_idx)")


@query("a13_impact_cells", with_views("ha", LAST_CELLS_SQL + "SELECT event_id, side, row, col, energy FROM cells"))
def a13(spark, sf):
    return features.impact_cells(hits_a(spark, sf), 3.0).select("event_id", "side", "row", "col", "energy")


@query(
    "a13_impact_cells_summed",
    with_views(
        "ha", CELLS_SQL.format(value="sum(energy)") + "SELECT event_id, side, row, col, energy FROM cells"
    ),
)
def a13_sum(spark, sf):
    out = features.impact_cells(hits_a(spark, sf), 3.0, combine="sum")
    return out.select("event_id", "side", "row", "col", "energy")


@query(
    "a13_impact_matrix",
    with_views("ha", LAST_CELLS_SQL + "SELECT event_id, side, row, col, energy FROM cells WHERE energy <> 0"),
)
def a13_matrix(spark, sf):
    dense = features.impact_matrix(features.impact_cells(hits_a(spark, sf), 3.0), features.matrix_side(128, 2))
    rows = dense.select("event_id", "side", F.posexplode("matrix").alias("row", "_r"))
    cells = rows.select("event_id", "side", "row", F.posexplode("_r").alias("col", "energy"))
    return cells.filter(F.col("energy") != 0)


@query(
    "a14_impact_profile",
    with_views(
        "ha",
        LAST_CELLS_SQL
        + """, ev AS (SELECT file_id, event_id FROM ha WHERE side = 1 GROUP BY ALL
                      HAVING sum(energy) > 20 AND sum(energy) < 120),
             c AS (SELECT cells.* FROM cells JOIN ev USING (file_id, event_id) WHERE side = 1),
             r AS (SELECT energy / max(energy) OVER (PARTITION BY file_id, event_id) AS share,
                          max(energy) OVER (PARTITION BY file_id, event_id) AS top,
                          row_number() OVER (PARTITION BY file_id, event_id ORDER BY energy DESC, row, col) AS rank
                   FROM c),
             s AS (SELECT rank, sum(share) AS share FROM r GROUP BY rank),
             n AS (SELECT count(*) AS n, sum(top) AS tops FROM r WHERE rank = 1)
             SELECT CAST(g.k AS INTEGER) AS rank, round_even(coalesce(share, 0) / n, 3) AS mean_share,
                    round_even(tops / n, 3) AS mean_max, n AS n_events
             FROM range(1, 65) g(k) CROSS JOIN n LEFT JOIN s ON s.rank = g.k""",
    ),
)
def a14(spark, sf):
    side1 = hits_a(spark, sf).filter(F.col("side") == 1)
    cells = features.impact_cells(side1, 3.0, total=True)
    event_total = F.sum("total").over(Window.partitionBy(*EVENT))
    kept = cells.withColumn("total", event_total).filter(filters.energy_window("total", 20, 120))
    return features.impact_profile(kept)


NEIGHBOUR_MODES = {
    "0x": "abs(dx) <= 3 AND dy = 0",
    "0y": "abs(dy) <= 3 AND dx = 0",
    "1": "(abs(dx) <= 3 AND dy = 0) OR (abs(dy) <= 3 AND dx = 0)",
    "2": "abs(dx) <= 3 AND abs(dy) <= 3",
    "3": "abs(dx) <= 6 AND abs(dy) <= 6",
}


@query(
    "a15_neighbour_hits",
    with_views(
        "ha",
        """, a AS (SELECT event_id, side, x AS ax, y AS ay FROM ha WHERE is_energy QUALIFY row_number() OVER (
                     PARTITION BY event_id, side ORDER BY energy DESC, hit_idx) = 1),
             d AS (SELECT ha.*, ax - x AS dx, ay - y AS dy FROM ha JOIN a USING (event_id, side))
        """
        + " UNION ALL ".join(
            f"SELECT '{m}' AS mode, event_id, side, hit_idx, channel FROM d WHERE {c}" for m, c in NEIGHBOUR_MODES.items()
        ),
    ),
)
def a15(spark, sf):
    h = hits_a(spark, sf)
    modes = {m: (int(m[0]), m[1:] or "x") for m in NEIGHBOUR_MODES}
    return features.neighbour_modes(h, modes, 3.0, 3.0).select("mode", "event_id", "side", "hit_idx", "channel")


@query(
    "a16_direct_slab",
    with_views(
        "hs_b",
        STRONGEST_TIME_SQL
        + """SELECT b.event_id, b.side, b.mm, t.channel AS slab_channel, t.time AS slab_time, t.energy AS slab_energy
             FROM best_b b LEFT JOIN t USING (event_id, side)""",
    ),
)
def a16(spark, sf):
    out = slabs.direct_slab(hits_b(spark, sf))
    return out.select("event_id", "side", "mm", "slab_channel", "slab_time", "slab_energy")


def light_sharing_sql(source: str, sides: str, interior: str = "batch") -> str:
    up, down = ("2 * p + 1", "2 * p") if interior == "batch" else ("2 * p", "2 * p + 1")
    return f""", r AS (SELECT event_id, side, slab, x, channel, row_number() OVER (
                         PARTITION BY event_id, side ORDER BY energy DESC, hit_idx) AS k FROM {source} WHERE is_time),
      t AS (SELECT event_id, side, max(slab) FILTER (WHERE k = 1) AS p, max(slab) FILTER (WHERE k = 2) AS q,
                   max(x) FILTER (WHERE k = 1) AS x, max(channel) FILTER (WHERE k = 1) AS time_channel,
                   count(*) AS n FROM r GROUP BY event_id, side)
      SELECT s.event_id, s.side, time_channel,
        CAST(CASE WHEN p IS NULL THEN NULL WHEN p IN (0, 7) THEN 0 WHEN n = 1 THEN 1 WHEN abs(p - q) > 1 THEN 2
                  ELSE 3 END AS INTEGER) AS flag,
        CAST(CASE WHEN p = 0 AND n >= 2 THEN 1 WHEN p = 0 THEN 0 WHEN p = 7 AND n >= 2 THEN 14 WHEN p = 7 THEN 15
                  WHEN n = 1 THEN p WHEN abs(p - q) > 1 THEN NULL
                  WHEN p - q = 1 THEN {up} ELSE {down} END AS INTEGER) AS slab,
        round(CASE WHEN p = 0 AND n >= 2 THEN x + 0.8::DOUBLE WHEN p = 0 THEN x - 0.8::DOUBLE
                   WHEN p = 7 AND n >= 2 THEN x - 0.8::DOUBLE WHEN p = 7 THEN x + 0.8::DOUBLE
                   WHEN n = 1 THEN x WHEN abs(p - q) > 1 THEN NULL
                   WHEN p - q = 1 THEN x + 0.8::DOUBLE ELSE x - 0.8::DOUBLE END, 6) AS slab_x
      FROM {sides} s LEFT JOIN t USING (event_id, side)"""


def settled(out, centre):
    """Leave the coin flip out of the comparison: half slab 2p or 2p + 1 becomes p, its position the channel centre."""
    flipped = F.col("flag") == 1
    half = F.floor(F.col("slab") / 2).cast("int")
    return out.select(
        "event_id",
        "side",
        "time_channel",
        "flag",
        F.when(flipped, half).otherwise(F.col("slab")).alias("slab"),
        F.round(F.when(flipped, centre).otherwise(F.col("slab_x")), 6).alias("slab_x"),
    )


def channel_centre():
    """x of a time channel in the row/column map."""
    line = F.floor((F.col("time_channel") % 16) / 2)
    return (line + F.lit(0.5)) * F.lit(3.2)


@query("a17_light_sharing_slab", with_views("hs_b", light_sharing_sql("hs_b", "best_b")))
def a17(spark, sf):
    return settled(slabs.light_sharing_slab(hits_b(spark, sf)), channel_centre())


@query(
    "a17_light_sharing_slab_all_hits",
    with_views("hb", light_sharing_sql("hb", "(SELECT DISTINCT event_id, side FROM hb)", "scalar")),
)
def a17_all(spark, sf):
    out = slabs.light_sharing_slab(hits_b(spark, sf), scope="all", interior="scalar")
    return settled(out, channel_centre())
