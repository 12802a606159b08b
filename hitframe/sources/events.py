"""From nested events to one row per hit, and positions encoded in file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_hits(events: DataFrame) -> DataFrame:
    """Long form of nested events, a narrow step; an event without hits has no rows here, see ``event_keys``."""
    sides = F.array(
        F.struct(F.lit(1).alias("side"), F.col("side1").alias("hits")),
        F.struct(F.lit(2).alias("side"), F.col("side2").alias("hits")),
    )
    keys = [c for c in events.columns if c not in ("side1", "side2")]
    per_side = events.select(*keys, F.inline(sides))
    return per_side.select(*keys, "side", F.posexplode("hits").alias("hit_idx", "_h")).select(
        *keys,
        "side",
        F.col("hit_idx").cast("smallint").alias("hit_idx"),
        F.col("_h.time").alias("time"),
        F.col("_h.energy").cast("double").alias("energy"),
        F.col("_h.channel").alias("channel"),
    )


def event_keys(events: DataFrame) -> DataFrame:
    """All events, including those without hits, for counting."""
    return events.select("file_id", "event_id")


def position_of(file_name: Column | str) -> Column:
    """Scan position from a file name: the first part between underscores that contains ``pos``, as a number."""
    name = F.col(file_name) if isinstance(file_name, str) else file_name
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    parts = F.filter(F.split(stem, "_"), lambda part: part.contains("pos"))
    return F.replace(F.get(parts, 0), F.lit("pos"), F.lit("")).cast("int")
