"""Lookups of hits and events in small dimension tables (channel map, skew, calibration, regions, pairs).

No join here forces a broadcast blindly. Pass the known row count of a dimension (a channel map built from a
configuration knows it) to hint a broadcast while it is within ``MAX_BROADCAST_ROWS``; otherwise Spark decides from
its size statistics, falling back to a shuffled join whose hot keys adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitframe.schema import MAX_BROADCAST_ROWS


def small_side(dim: DataFrame, rows: int | None = None) -> DataFrame:
    """Hint ``dim`` for broadcast only if its proven row count allows it."""
    return F.broadcast(dim) if rows is not None and rows <= MAX_BROADCAST_ROWS else dim


def lookup(
    df: DataFrame,
    dim: DataFrame,
    on: list[str],
    unmapped: str = "fail",
    rows: int | None = None,
) -> DataFrame:
    """Join ``df`` with a dimension that is unique on ``on`` (see ``unique``).

    ``unmapped`` says what happens to rows without a partner: ``fail`` (the default), ``drop`` them, or ``keep`` them with NULLs.
    """
    if unmapped == "drop":
        return df.join(small_side(dim, rows), on)
    if unmapped == "keep":
        return df.join(small_side(dim, rows), on, "left")
    if unmapped != "fail":
        raise ValueError(f"unmapped must be drop, keep or fail, not {unmapped!r}")
    marked = dim.withColumn("_known", F.lit(True))
    key = F.concat_ws(",", *[F.col(c).cast("string") for c in on])
    message = F.concat(F.lit(f"no entry for {', '.join(on)} = "), key)
    # The error sits in a filter, which column pruning cannot remove.
    known = F.when(F.col("_known"), True).otherwise(F.raise_error(message).cast("boolean"))
    return df.join(small_side(marked, rows), on, "left").filter(known).drop("_known")


def unique(dim: DataFrame, on: list[str]) -> DataFrame:
    """``dim``, with an error for a key that it has twice; otherwise such a key would multiply the rows that look it up."""
    others = [F.any_value(c).alias(c) for c in dim.columns if c not in on]
    counted = dim.groupBy(*on).agg(F.count("*").alias("_times"), *others)
    message = F.concat(F.lit(f"more than one entry for {', '.join(on)} = "), F.concat_ws(",", *[F.col(c).cast("string") for c in on]))
    once = F.when(F.col("_times") == 1, True).otherwise(F.raise_error(message).cast("boolean"))
    return counted.filter(once).select(*dim.columns)


def with_channels(
    hits: DataFrame, channel_map: DataFrame, unmapped: str = "fail", rows: int | None = None
) -> DataFrame:
    """Add module, type and position columns of the channel map to every hit."""
    return lookup(hits, channel_map, ["channel"], unmapped, rows)


def unmapped_channels(hits: DataFrame, channel_map: DataFrame) -> DataFrame:
    """Channels that occur in the data but not in the map, with their hit count.

    Counting first shrinks the data to one row per channel before the anti join.
    """
    counts = hits.groupBy("channel").agg(F.count("*").alias("n_hits"))
    return counts.join(channel_map.select("channel"), "channel", "left_anti")


def with_skew(hits: DataFrame, skew: DataFrame, rows: int | None = None) -> DataFrame:
    """Add the time skew of each channel, 0 where the table has none."""
    joined = lookup(hits, unique(skew.select("channel", "skew"), ["channel"]), ["channel"], "keep", rows)
    return joined.withColumn("skew", F.coalesce("skew", F.lit(0.0)))


def with_calibration(
    df: DataFrame, calibration: DataFrame, on: list[str], unmapped: str = "fail", rows: int | None = None
) -> DataFrame:
    """Add calibration coefficients by channel, module, or (time channel, slab)."""
    return lookup(df, unique(calibration, on), on, unmapped, rows)


def with_region(df: DataFrame, region_map: DataFrame, rows: int | None = None) -> DataFrame:
    """Add region and position offset of the module (sm, mm); NULL region and zero offset where missing."""
    regions = unique(region_map.select("sm", "mm", "region", "off_x", "off_y"), ["sm", "mm"])
    joined = lookup(df, regions, ["sm", "mm"], "keep", rows)
    return joined.withColumns(
        {"off_x": F.coalesce("off_x", F.lit(0.0)), "off_y": F.coalesce("off_y", F.lit(0.0))}
    )


def with_pair(
    df: DataFrame,
    pair_map: DataFrame,
    first: str = "region1",
    second: str = "region2",
    max_region: int | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Add the id of the ordered region pair; NULL where the pair or one region is missing."""
    # NULL keys match nothing
    table = pair_map.filter(F.col("s0").isNotNull() & F.col("s1").isNotNull())
    if max_region is not None:
        table = table.filter((F.col("s0") < max_region) & (F.col("s1") < max_region))
    table = table.select(F.col("s0").alias(first), F.col("s1").alias(second), F.col("p").alias("pair"))
    return lookup(df, unique(table, [first, second]), [first, second], "keep", rows)


def with_decompression(
    df: DataFrame,
    dec_map: DataFrame,
    max_channel: int | Column | None = None,
    max_slab: int | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Add the decompression range (y_min, y_max) of (time_ch, slab); entries outside the bounds, if there are any, do not count."""
    table = dec_map if max_slab is None else dec_map.filter(F.col("slab") < max_slab)
    if max_channel is not None:
        table = table.filter(F.col("time_ch") < max_channel)
    return lookup(df, unique(table.select("time_ch", "slab", "y_min", "y_max"), ["time_ch", "slab"]), ["time_ch", "slab"], "keep", rows)


def with_lor_skew(df: DataFrame, lor_skew: DataFrame, rows: int | None = None) -> DataFrame:
    """Add the skew of the line of response identified by ``pair``; NULL where missing."""
    return lookup(df, unique(lor_skew.select("pair", F.col("skew").alias("lor_skew")), ["pair"]), ["pair"], "keep", rows)
