"""Channel map: suppliers stand for detector modules, one front end each; the channel lists follow a rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from hitframe import maps
from hitframe.functions import electronics
from hitframe.maps.channel_map import Layout
from workload.fixtures import table
from workload.registry import query

# Channel lists by rule: permutations of the lower and upper half, or of the even and odd channels.
PIXEL_LISTS = ([i * 37 % 64 for i in range(64)], [64 + i * 29 % 64 for i in range(64)])
SUM_LISTS = ([i * 37 % 128 * 2 for i in range(128)], [i * 53 % 128 * 2 + 1 for i in range(128)])
WIDE_LISTS = ([i * 37 % 128 for i in range(128)], [128 + i * 53 % 128 for i in range(128)])

PIXEL = Layout("FEM128", 3.0, 3.0, 64, False)
WIDE = Layout("FEM256", 2.5, 2.5, 128, False)
SUMS = Layout("FEM256", 3.0, 3.0, 8, True)
SUMS_STRAIGHT = Layout("FEM256", 3.0, 3.0, 8, True, "straight")


def places(spark, sf, febports: int):
    s = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        s.cast("int").alias("sm"),
        F.floor(s / (febports * 32)).cast("int").alias("port"),
        F.pmod(F.floor(s / febports), F.lit(32)).cast("int").alias("slave"),
        (s % febports).cast("int").alias("febport"),
    )


def places_sql(febports: int) -> str:
    return f"""places AS (SELECT CAST(s_suppkey AS INTEGER) AS sm, 131072 * (s_suppkey // {febports * 32})
      + 4096 * ((s_suppkey // {febports}) % 32) + {4096 // febports} * (s_suppkey % {febports}) AS base FROM supplier)"""


PIXEL_SQL = f"""WITH {places_sql(32)},
  entries AS (SELECT CAST(i AS INTEGER) AS i, i * 37 % 64 AS off, 0 AS second FROM range(64) r(i)
           UNION ALL SELECT CAST(i AS INTEGER), 64 + i * 29 % 64, 1 FROM range(64) r(i)),
  cm AS (SELECT CAST(base + off AS INTEGER) AS channel, sm, CAST(i // 64 + second AS INTEGER) AS mm, true AS is_time,
           true AS is_energy, (i % 8 + 0.5::DOUBLE) * 3 AS x, (i // 8 + 0.5::DOUBLE) * 3 AS y,
           CAST(NULL AS INTEGER) AS slab FROM places, entries)
"""
WIDE_SQL = f"""WITH {places_sql(16)},
  entries AS (SELECT CAST(i AS INTEGER) AS i, i * 37 % 128 AS off, 0 AS second FROM range(128) r(i)
           UNION ALL SELECT CAST(i AS INTEGER), 128 + i * 53 % 128, 1 FROM range(128) r(i)),
  cm AS (SELECT CAST(base + off AS INTEGER) AS channel, sm, CAST(i // 128 + second AS INTEGER) AS mm, true AS is_time,
           true AS is_energy, round((i % 16 + 0.5::DOUBLE) * 2.5::DOUBLE, 2) AS x,
           round((i // 16 + 0.5::DOUBLE) * 2.5::DOUBLE, 2) AS y, CAST(NULL AS INTEGER) AS slab FROM places, entries)
"""


def sums_sql(straight: bool = False) -> str:
    energy_mm = "i // 8" if straight else "(i // 8) % 4 * 4 + (i // 8) // 4"
    # A printed number is rounded from its exact binary value, as the map rounds.
    fine = "(3.2::DOUBLE + 0.205::DOUBLE) / 2 + 0.205::DOUBLE * (row // 8) + 3.2::DOUBLE * row"
    coarse = "25.805::DOUBLE * (3.5::DOUBLE - i // 32)"
    return f"""WITH {places_sql(16)},
  entries AS (SELECT CAST(i AS INTEGER) AS i, 31 - i % 32 AS row, i * 37 % 128 * 2 AS off, 0 AS second FROM range(128) r(i)
           UNION ALL SELECT CAST(i AS INTEGER), 31 - i % 32, i * 53 % 128 * 2 + 1, 1 FROM range(128) r(i)),
  pos AS (SELECT *, CAST(format('{{:.3f}}', {fine}) AS DOUBLE) AS fine,
                 CAST(format('{{:.3f}}', {coarse}) AS DOUBLE) AS coarse FROM entries),
  cm AS (SELECT CAST(base + off AS INTEGER) AS channel, sm,
           CAST(CASE WHEN second = 0 THEN i // 8 ELSE {energy_mm} END AS INTEGER) AS mm, second = 0 AS is_time,
           second = 1 AS is_energy, CASE WHEN second = 0 THEN fine ELSE coarse END AS x,
           CASE WHEN second = 0 THEN coarse ELSE fine END AS y, CAST(row % 8 AS INTEGER) AS slab FROM places, pos)
"""


def pixel_map(spark, sf):
    return maps.channel_map(places(spark, sf, 32), *PIXEL_LISTS, PIXEL)


def wide_map(spark, sf):
    return maps.channel_map(places(spark, sf, 16), *WIDE_LISTS, WIDE)


def sums_map(spark, sf, layout=SUMS):
    return maps.channel_map(places(spark, sf, 16), *SUM_LISTS, layout)


FULL = "channel, sm, mm, is_time, is_energy, x, y, slab"


@query("m01_channel_map", PIXEL_SQL + f"SELECT {FULL} FROM cm")
def m01(spark, sf):
    return pixel_map(spark, sf).select(*FULL.split(", "))


@query("m01_channel_map_rowcol", sums_sql() + f"SELECT {FULL} FROM cm")
def m01_rowcol(spark, sf):
    return sums_map(spark, sf).select(*FULL.split(", "))


@query("m02_module_assignment", sums_sql() + "SELECT channel, sm, mm, sm * 1000 + mm AS mm_id FROM cm")
def m02(spark, sf):
    return sums_map(spark, sf).select("channel", "sm", "mm", "mm_id")


@query("m03_channel_types", sums_sql() + "SELECT channel, is_time, is_energy FROM cm")
def m03(spark, sf):
    return sums_map(spark, sf).select("channel", "is_time", "is_energy")


@query("m04_coordinates_fem128", PIXEL_SQL + "SELECT channel, x, y FROM cm")
def m04(spark, sf):
    return pixel_map(spark, sf).select("channel", "x", "y")


@query("m05_coordinates_fem256", WIDE_SQL + "SELECT channel, mm, x, y FROM cm")
def m05(spark, sf):
    return wide_map(spark, sf).select("channel", "mm", "x", "y")


@query("m06_coordinates_rowcol", sums_sql() + "SELECT channel, is_time, x, y, slab FROM cm")
def m06(spark, sf):
    return sums_map(spark, sf).select("channel", "is_time", "x", "y", "slab")


@query("m07_straight_geometry", sums_sql(straight=True) + "SELECT channel, sm, mm, is_energy FROM cm")
def m07(spark, sf):
    return sums_map(spark, sf, SUMS_STRAIGHT).select("channel", "sm", "mm", "is_energy")


@query(
    "m08_electronics_numbers",
    """SELECT channel, CAST(channel // 131072 AS INTEGER) AS port, CAST(channel % 131072 // 4096 AS INTEGER) AS slave,
              CAST(channel % 131072 % 4096 // 64 AS INTEGER) AS chip, CAST(channel % 64 AS INTEGER) AS chip_channel,
              channel AS rebuilt
       FROM (SELECT CAST(l_partkey * 97 + l_suppkey * 4099 AS INTEGER) AS channel FROM lineitem)""",
)
def m08(spark, sf):
    channel = (F.col("l_partkey") * 97 + F.col("l_suppkey") * 4099).cast("int").alias("channel")
    rows = table(spark, sf, "lineitem").select(channel)
    numbered = rows.select("channel", *electronics.electronics("channel"))
    names = ("port", "slave", "chip", "chip_channel")
    return numbered.withColumn("rebuilt", electronics.absolute_id(*[F.col(n) for n in names]))


# Suppliers share a front end here on purpose: two of them in every slot.
CLASH_SQL = f"""WITH places AS (SELECT CAST(s_suppkey AS INTEGER) AS sm,
      131072 * (s_suppkey // 64 // 16) + 4096 * ((s_suppkey // 64) % 16) + 128 * ((s_suppkey // 2) % 32) AS base
    FROM supplier), {PIXEL_SQL.split(",", 1)[1].split("FROM supplier),", 1)[1]}"""


def clashing_places(spark, sf):
    s = F.col("s_suppkey")
    group = F.floor(s / 64)
    return table(spark, sf, "supplier").select(
        s.cast("int").alias("sm"),
        F.floor(group / 16).cast("int").alias("port"),
        (group % 16).cast("int").alias("slave"),
        F.pmod(F.floor(s / 2), F.lit(32)).cast("int").alias("febport"),
    )


@query(
    "m09_duplicate_channels",
    CLASH_SQL + "SELECT channel, count(*) AS n_claims FROM cm GROUP BY channel HAVING count(*) > 1",
)
def m09(spark, sf):
    return maps.duplicate_channels(maps.channel_map(clashing_places(spark, sf), *PIXEL_LISTS, PIXEL))


@query(
    "m09_module_collisions",
    CLASH_SQL
    + """SELECT CAST(base AS INTEGER) AS first_channel, count(*) AS n_modules FROM places GROUP BY base
         HAVING count(*) > 1""",
)
def m09_modules(spark, sf):
    return maps.module_collisions(clashing_places(spark, sf), PIXEL)


@query(
    "m10_channel_listing",
    PIXEL_SQL
    + """SELECT CAST(channel // 131072 AS INTEGER) AS port, CAST(channel % 131072 // 4096 AS INTEGER) AS slave,
                CAST(channel % 4096 // 64 AS INTEGER) AS chip, count(*) AS n_channels,
                string_agg(CAST(channel AS VARCHAR), ' ' ORDER BY channel) AS channels,
                round(sum(x), 6) AS sum_x
         FROM cm GROUP BY 1, 2, 3""",
)
def m10(spark, sf):
    listed = maps.channel_listing(pixel_map(spark, sf))
    ids = F.transform("channels", lambda c: c["channel"].cast("string"))
    total = F.aggregate("channels", F.lit(0.0), lambda a, c: a + c["x"])
    return listed.select(
        "port", "slave", "chip", "n_channels", F.array_join(ids, " ").alias("channels"), F.round(total, 6).alias("sum_x")
    )


@query(
    "m11_lookup_tables",
    sums_sql()
    + """SELECT channel, sm * 1000 + mm AS mm_id, 'energy' AS kind FROM cm WHERE is_energy
         UNION ALL SELECT channel, sm * 1000 + mm, 'time' FROM cm WHERE is_time""",
)
def m11(spark, sf):
    return maps.typed_module_ids(sums_map(spark, sf))


@query(
    "m11_bounded_tables",
    """SELECT CAST(p_partkey AS INTEGER) AS time_ch, p_size % 20 AS slab, p_retailprice AS y_min FROM part
       WHERE p_partkey < 1500 AND p_size % 20 < 16""",
)
def m11_bounded(spark, sf):
    dec_map = table(spark, sf, "part").select(
        F.col("p_partkey").cast("int").alias("time_ch"), (F.col("p_size") % 20).alias("slab"), F.col("p_retailprice").alias("y_min")
    )
    return maps.bounded_decompression(dec_map, max_channel=1500, max_slab=16)
