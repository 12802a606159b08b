"""Lookups: channel map, skew, calibration, regions, pairs, decompression, line-of-response skew, side pairing."""

from __future__ import annotations

from pyspark.sql import functions as F

from hitframe.operators import filters, lookups
from hitframe.operators.features import total_energy
from workload.fixtures import MAP_ROWS, hits, hits_a, map_a, table, with_views
from workload.registry import query


def wide_hits(spark, sf):
    """Hits on 300 channels, of which the map knows 256."""
    return hits(spark, sf).withColumn("channel", F.pmod(F.floor(F.col("hit_idx") / 1000000), F.lit(300)).cast("int"))


WIDE_SQL = """
, wide AS (SELECT * REPLACE (CAST((hit_idx // 1000000) % 300 AS INTEGER) AS channel) FROM hits)
"""


@query(
    "j01_channel_lookup",
    with_views(
        "hits map_a",
        WIDE_SQL
        + """SELECT event_id, side, hit_idx, time, energy, channel, sm, mm, x, y, slab
             FROM wide JOIN map_a USING (channel)""",
    ),
)
def j01(spark, sf):
    out = lookups.with_channels(wide_hits(spark, sf), map_a(spark), "drop", MAP_ROWS)
    return out.select("event_id", "side", "hit_idx", "time", "energy", "channel", "sm", "mm", "x", "y", "slab")


@query(
    "j01_channel_lookup_keep",
    with_views(
        "hits map_a",
        WIDE_SQL + "SELECT event_id, side, hit_idx, channel, mm_id FROM wide LEFT JOIN map_a USING (channel)",
    ),
)
def j01_keep(spark, sf):
    out = lookups.with_channels(wide_hits(spark, sf), map_a(spark), "keep", MAP_ROWS)
    return out.select("event_id", "side", "hit_idx", "channel", "mm_id")


@query(
    "j02_unmapped_channels",
    with_views(
        "hits map_a",
        WIDE_SQL
        + """SELECT channel, count(*) AS n_hits FROM wide
             WHERE channel NOT IN (SELECT channel FROM map_a) GROUP BY channel""",
    ),
)
def j02(spark, sf):
    return lookups.unmapped_channels(wide_hits(spark, sf), map_a(spark))


def skew_table(spark, sf):
    """Suppliers as channels with a time skew."""
    s = table(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").cast("int").alias("channel"), (F.col("s_acctbal") / 1000).alias("skew"))


SKEW_SQL = ", skew AS (SELECT CAST(s_suppkey AS INTEGER) AS channel, s_acctbal / 1000 AS skew FROM supplier)\n"


@query(
    "j03_skew_lookup",
    with_views(
        "hits",
        SKEW_SQL
        + """SELECT event_id, side, hit_idx, channel, coalesce(skew, 0) AS skew
             FROM hits LEFT JOIN skew USING (channel)""",
    ),
)
def j03(spark, sf):
    out = lookups.with_skew(hits(spark, sf), skew_table(spark, sf))
    return out.select("event_id", "side", "hit_idx", "channel", "skew")


def line_energies(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_partkey").alias("part_id"),
        F.col("l_suppkey").alias("id"),
        F.col("l_quantity").alias("energy"),
    )


def mu_table(spark, sf):
    s = table(spark, sf, "supplier")
    mu = F.when(F.col("s_suppkey") % 10 == 0, 0.0).otherwise(F.col("s_acctbal"))
    return s.select(F.col("s_suppkey").alias("id"), mu.alias("mu"))


MU_SQL = "mu AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 10 = 0 THEN 0 ELSE s_acctbal END AS mu FROM supplier)"


@query(
    "j04_calibration_lookup",
    f"""WITH {MU_SQL}
        SELECT l_orderkey, l_linenumber, l_partkey AS part_id, l_suppkey AS id, l_quantity AS energy, mu
        FROM lineitem JOIN mu ON id = l_suppkey""",
)
def j04(spark, sf):
    return lookups.with_calibration(line_energies(spark, sf), mu_table(spark, sf), ["id"], "fail")


@query(
    "j05_region_lookup",
    """WITH region_map AS (
         SELECT CAST(s_suppkey AS INTEGER) AS sm, s_nationkey AS mm, CAST(s_suppkey % 120 AS INTEGER) AS region,
                s_acctbal / 100 AS off_x, s_acctbal / 50 AS off_y FROM supplier)
       SELECT l_orderkey, l_partkey, l.sm, l.mm, region, coalesce(off_x, 0) AS off_x, coalesce(off_y, 0) AS off_y
       FROM (SELECT l_orderkey, l_partkey, CAST(l_suppkey AS INTEGER) AS sm, l_linenumber AS mm FROM lineitem) l
       LEFT JOIN region_map r ON l.sm = r.sm AND l.mm = r.mm""",
)
def j05(spark, sf):
    region_map = table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("int").alias("sm"),
        F.col("s_nationkey").alias("mm"),
        (F.col("s_suppkey") % 120).cast("int").alias("region"),
        (F.col("s_acctbal") / 100).alias("off_x"),
        (F.col("s_acctbal") / 50).alias("off_y"),
    )
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", F.col("l_suppkey").cast("int").alias("sm"), F.col("l_linenumber").alias("mm")
    )
    out = lookups.with_region(rows, region_map)
    return out.select("l_orderkey", "l_partkey", "sm", "mm", "region", "off_x", "off_y")


@query(
    "j06_pair_lookup",
    """WITH pair_map AS (
         SELECT n_nationkey * 10 + n_regionkey AS p, n_nationkey + 90 AS s0, n_regionkey AS s1 FROM nation)
       SELECT l_orderkey, l_partkey, region1, region2, p AS pair
       FROM (SELECT l_orderkey, l_partkey, CAST(l_suppkey % 30 + 90 AS INTEGER) AS region1, l_linenumber AS region2
             FROM lineitem) l LEFT JOIN pair_map ON s0 = region1 AND s1 = region2""",
)
def j06(spark, sf):
    n = table(spark, sf, "nation")
    pair_map = n.select(
        (F.col("n_nationkey") * 10 + F.col("n_regionkey")).alias("p"),
        (F.col("n_nationkey") + 90).alias("s0"),
        F.col("n_regionkey").alias("s1"),
    )
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        (F.col("l_suppkey") % 30 + 90).cast("int").alias("region1"),
        F.col("l_linenumber").alias("region2"),
    )
    return lookups.with_pair(rows, pair_map).select("l_orderkey", "l_partkey", "region1", "region2", "pair")


@query(
    "j07_decompression_lookup",
    """WITH dec_map AS (
         SELECT CAST(p_partkey AS INTEGER) AS time_ch, p_size % 20 AS slab, p_size / 10.0::DOUBLE AS y_min,
                p_retailprice / 10 AS y_max FROM part)
       SELECT l_orderkey, l.time_ch, l.slab, y_min, y_max
       FROM (SELECT l_orderkey, CAST(l_partkey AS INTEGER) AS time_ch,
                    CAST(l_quantity AS INTEGER) % 20 AS slab FROM lineitem) l
       LEFT JOIN dec_map d ON d.time_ch = l.time_ch AND d.slab = l.slab""",
)
def j07(spark, sf):
    dec_map = table(spark, sf, "part").select(
        F.col("p_partkey").cast("int").alias("time_ch"),
        (F.col("p_size") % 20).alias("slab"),
        (F.col("p_size") / 10.0).alias("y_min"),
        (F.col("p_retailprice") / 10).alias("y_max"),
    )
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey",
        F.col("l_partkey").cast("int").alias("time_ch"),
        (F.col("l_quantity").cast("int") % 20).alias("slab"),
    )
    out = lookups.with_decompression(rows, dec_map)
    return out.select("l_orderkey", "time_ch", "slab", "y_min", "y_max")


@query(
    "j08_lor_skew_lookup",
    """SELECT l_orderkey, pair, s_acctbal AS lor_skew
       FROM (SELECT l_orderkey, CAST(l_suppkey + 50 AS INTEGER) AS pair FROM lineitem) l
       LEFT JOIN supplier ON s_suppkey = pair""",
)
def j08(spark, sf):
    skew = table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("int").alias("pair"), F.col("s_acctbal").alias("skew")
    )
    rows = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_suppkey") + 50).cast("int").alias("pair"))
    return lookups.with_lor_skew(rows, skew).select("l_orderkey", "pair", "lor_skew")


@query(
    "j09_pair_sides",
    with_views(
        "ha",
        """SELECT event_id, sum(energy) FILTER (WHERE side = 1) AS energy1,
                  sum(energy) FILTER (WHERE side = 2) AS energy2,
                  nullif(count(*) FILTER (WHERE side = 1), 0) AS n_energy1,
                  nullif(count(*) FILTER (WHERE side = 2), 0) AS n_energy2
           FROM ha GROUP BY event_id""",
    ),
)
def j09(spark, sf):
    pairs = filters.pair_sides(total_energy(hits_a(spark, sf)), ["energy", "n_energy"])
    return pairs.select("event_id", "energy1", "energy2", "n_energy1", "n_energy2")
