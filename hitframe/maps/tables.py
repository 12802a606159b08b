"""Small lookup tables derived from, or used beside, the channel map. Missing entries are absent rows, not sentinels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def type_channels(channel_map: DataFrame, kind: str) -> DataFrame:
    """Channels of type ``time`` or ``energy``."""
    return channel_map.filter(F.col(f"is_{kind}")).select("channel")


def module_ids(channel_map: DataFrame, *others: str) -> DataFrame:
    """Module number ``sm * 1000 + mm`` of every channel, beside any ``others`` of its columns."""
    return channel_map.select("channel", (F.col("sm") * 1000 + F.col("mm")).alias("mm_id"), *others)


def typed_module_ids(channel_map: DataFrame) -> DataFrame:
    """Module number of every channel with its type, ``energy`` or ``time``; a channel of both types has two rows.

    The types of an entry stand beside it, so the map is read once and neither joined nor moved.
    """
    kinds = F.array(*[F.when(F.col(f"is_{kind}"), F.lit(kind)) for kind in ("energy", "time")])
    typed = channel_map.select("channel", "sm", "mm", F.explode(F.array_compact(kinds)).alias("kind"))
    return module_ids(typed, "kind")


def bounded_regions(region_map: DataFrame, max_region: int) -> DataFrame:
    """Regions of modules, only those below the bound that the pair table allows."""
    return region_map.filter(F.col("region") < max_region)


def bounded_decompression(dec_map: DataFrame, max_channel: int | None = None, max_slab: int | None = None) -> DataFrame:
    """Decompression ranges whose channel and slab lie within the bounds; without a bound, all."""
    kept = dec_map if max_slab is None else dec_map.filter(F.col("slab") < max_slab)
    return kept if max_channel is None else kept.filter(F.col("time_ch") < max_channel)
