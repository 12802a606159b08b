"""Small hand-written hit tables and plain-Python restatements of the rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

HIT_FIELDS = (
    "file_id int, event_id bigint, side int, hit_idx int, time bigint, energy double, channel int, sm int, mm int, "
    "mm_id int, is_time boolean, is_energy boolean, x double, y double, slab int"
)


def hit(event=0, side=1, idx=0, time=0, energy=1.0, channel=0, sm=0, mm=0, kind="both", x=0.5, y=0.5, slab=0):
    return (
        0, event, side, idx, time, float(energy), channel, sm, mm, sm * 1000 + mm,
        kind in ("both", "time"), kind in ("both", "energy"), float(x), float(y), slab,
    )


def hits(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame(list(rows), HIT_FIELDS)


def by_side(df: DataFrame, *columns: str) -> dict:
    """(event, side) -> row values of a small result."""
    return {(r["event_id"], r["side"]): tuple(r[c] for c in columns) for r in df.collect()}


def by_event(df: DataFrame, *columns: str) -> dict:
    return {r["event_id"]: tuple(r[c] for c in columns) for r in df.collect()}
