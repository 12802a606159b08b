"""The given tables seen as detector hits: one order is an event, one line item a hit, the line status its side.

Every function has its SQL twin; ``with_views`` puts the common table expressions in front of a statement.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Hits of a side are listed by part, then line number, then ship day, packed into one integer: a single fixed-width
# number keeps minimum and maximum aggregates in hash aggregation. Rows that agree in all three are the same hit.

HITS_SQL = """
hits AS (
  SELECT CAST(l_orderkey // 1000000 AS INTEGER) AS file_id, l_orderkey AS event_id,
         CASE WHEN l_linestatus = 'F' THEN 1 ELSE 2 END AS side,
         (l_partkey * 10 + l_linenumber) * 100000 + CAST(epoch(l_shipdate) AS BIGINT) // 86400 AS hit_idx,
         CAST(epoch(l_shipdate) AS BIGINT) * 1000 + l_partkey * 10 + l_linenumber AS time,
         l_quantity AS energy, CAST(l_partkey % 256 AS INTEGER) AS channel
  FROM lineitem)
"""

MAP_A_SQL = """
map_a AS (
  SELECT CAST(c AS INTEGER) AS channel, CAST(c // 128 AS INTEGER) AS sm, CAST((c % 128) // 64 AS INTEGER) AS mm,
         CAST((c // 128) * 1000 + (c % 128) // 64 AS INTEGER) AS mm_id, true AS is_time, true AS is_energy,
         ((c % 64) % 8 + 0.5::DOUBLE) * 3 AS x, ((c % 64) // 8 + 0.5::DOUBLE) * 3 AS y,
         CAST((c % 64) % 8 AS INTEGER) AS slab
  FROM range(256) r(c))
"""

MAP_B_SQL = """
map_b AS (
  SELECT CAST(c AS INTEGER) AS channel, CAST(0 AS INTEGER) AS sm, CAST(c // 16 AS INTEGER) AS mm,
         CAST(c // 16 AS INTEGER) AS mm_id, c % 2 = 0 AS is_time, c % 2 = 1 AS is_energy,
         ((c % 16) // 2 + 0.5::DOUBLE) * 3.2::DOUBLE AS x, ((c % 16) // 2 + 0.5::DOUBLE) * 3.2::DOUBLE AS y,
         CAST((c % 16) // 2 AS INTEGER) AS slab
  FROM range(256) r(c))
"""

VIEWS = {
    "hits": HITS_SQL,
    "map_a": MAP_A_SQL,
    "map_b": MAP_B_SQL,
    "ha": "ha AS (SELECT hits.*, map_a.* EXCLUDE (channel) FROM hits JOIN map_a USING (channel))",
    "hb": "hb AS (SELECT hits.*, map_b.* EXCLUDE (channel) FROM hits JOIN map_b USING (channel))",
}
for _m in "ab":
    VIEWS[f"mods_{_m}"] = f"""
mods_{_m} AS (
  SELECT file_id, event_id, side, sm, mm, mm_id, coalesce(sum(energy) FILTER (WHERE is_energy), 0) AS module_energy,
         min(hit_idx) AS first_idx
  FROM h{_m} GROUP BY ALL)"""
    VIEWS[f"best_{_m}"] = f"""
best_{_m} AS (
  SELECT file_id, event_id, side, sm, mm, mm_id, module_energy FROM mods_{_m}
  QUALIFY row_number() OVER (PARTITION BY file_id, event_id, side ORDER BY module_energy DESC, first_idx) = 1)"""
    VIEWS[f"hs_{_m}"] = f"""
hs_{_m} AS (
  SELECT h.*, b.module_energy FROM h{_m} h JOIN best_{_m} b USING (file_id, event_id, side, sm, mm))"""

NEEDS = {"ha": ["hits", "map_a"], "hb": ["hits", "map_b"]}
for _m in "ab":
    NEEDS[f"mods_{_m}"] = [f"h{_m}"]
    NEEDS[f"best_{_m}"] = [f"mods_{_m}"]
    NEEDS[f"hs_{_m}"] = [f"best_{_m}"]


def _closed(names: list[str]) -> list[str]:
    out: list[str] = []
    for name in names:
        out += [n for n in [*_closed(NEEDS.get(name, [])), name] if n not in out]
    return out


def with_views(views: str, body: str) -> str:
    """SQL statement with the named common table expressions and those they need; ``body`` may add more CTEs by
    starting with a comma."""
    ctes = ",".join(VIEWS[n].strip() for n in _closed(views.split()))
    return f"WITH {ctes}\n{body.strip()}"


# --- Spark side -------------------------------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_days(column: str):
    return F.datediff(F.to_date(F.col(column)), F.lit("1970-01-01").cast("date")).cast("bigint")


def epoch_seconds(column: str):
    """Seconds since 1970 of a zone-less timestamp, whatever the session zone is."""
    c = F.col(column)
    return epoch_days(column) * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)


#: The place of a row in a table: ``hits(..., placed=True)`` has these columns.
PLACE = ["file", "row"]


def hits(spark: SparkSession, sf_dir: str, placed: bool = False) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")] if placed else []
    return line.select(
        F.floor(F.col("l_orderkey") / 1000000).cast("int").alias("file_id"),
        F.col("l_orderkey").alias("event_id"),
        F.when(F.col("l_linestatus") == "F", 1).otherwise(2).alias("side"),
        ((F.col("l_partkey") * 10 + F.col("l_linenumber")) * 100000 + epoch_days("l_shipdate")).alias("hit_idx"),
        (epoch_seconds("l_shipdate") * 1000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("time"),
        F.col("l_quantity").alias("energy"),
        (F.col("l_partkey") % 256).cast("int").alias("channel"),
        *place,
    )


def _div(a, b: int):
    return F.floor(a / b).cast("int")


def map_a(spark: SparkSession) -> DataFrame:
    """Pixel readout: 2 modules of 2 minimodules, every channel has both types."""
    c = F.col("channel")
    p = c % 64
    return spark.range(256).select(F.col("id").cast("int").alias("channel")).select(
        "channel",
        _div(c, 128).alias("sm"),
        _div(c % 128, 64).alias("mm"),
        (_div(c, 128) * 1000 + _div(c % 128, 64)).alias("mm_id"),
        F.lit(True).alias("is_time"),
        F.lit(True).alias("is_energy"),
        ((p % 8 + F.lit(0.5)) * 3).alias("x"),
        ((_div(p, 8) + F.lit(0.5)) * 3).alias("y"),
        (p % 8).cast("int").alias("slab"),
    )


def map_b(spark: SparkSession) -> DataFrame:
    """Row/column readout: 16 minimodules of 8 time and 8 energy channels."""
    c = F.col("channel")
    line = _div(c % 16, 2)
    return spark.range(256).select(F.col("id").cast("int").alias("channel")).select(
        "channel",
        F.lit(0).alias("sm"),
        _div(c, 16).alias("mm"),
        _div(c, 16).alias("mm_id"),
        (c % 2 == 0).alias("is_time"),
        (c % 2 == 1).alias("is_energy"),
        ((line + F.lit(0.5)) * F.lit(3.2)).alias("x"),
        ((line + F.lit(0.5)) * F.lit(3.2)).alias("y"),
        line.alias("slab"),
    )


MAP_ROWS = 256


def hits_a(spark: SparkSession, sf_dir: str, placed: bool = False) -> DataFrame:
    from hitframe.operators.lookups import with_channels

    return with_channels(hits(spark, sf_dir, placed), map_a(spark), rows=MAP_ROWS)


def hits_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hitframe.operators.lookups import with_channels

    return with_channels(hits(spark, sf_dir), map_b(spark), rows=MAP_ROWS)
