"""Histograms, flood maps and their statistics per detector module.

Counts are partial aggregates: a map task sends at most one row per (group, bin), whatever the share of a module is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitframe.functions.bins import bin_high, bin_index, bin_low, centre

# Default axes of spectra and flood maps.
SPECTRUM_BINS, SPECTRUM_RANGE = 250, (0.0, 100.0)
FLOOD_BINS, FLOOD_RANGE = 200, (0.0, 26.0)


def with_edges(hist: DataFrame, low: float, high: float, n: int) -> DataFrame:
    return hist.withColumns({"lo": bin_low("bin", low, high, n), "hi": bin_high("bin", low, high, n)})


def histogram(
    df: DataFrame,
    value: str,
    bins: int = SPECTRUM_BINS,
    limits: tuple[float, float] = SPECTRUM_RANGE,
    by: list[str] | None = None,
    fill: bool = False,
) -> DataFrame:
    """Counts per bin (and group) with bin edges; values outside the limits are not counted.

    ``fill`` adds the empty bins of every group that has at least one count.
    """
    by = by or []
    low, high = limits
    binned = df.select(*by, bin_index(value, low, high, bins).alias("bin")).filter(F.col("bin").isNotNull())
    counts = binned.groupBy(*by, "bin").agg(F.count("*").alias("count"))
    if fill:
        groups = counts.groupBy(*by).agg(F.first("bin").alias("_any"))
        grid = groups.select(*by, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
        counts = grid.join(counts, [*by, "bin"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    return with_edges(counts, low, high, bins)


def flood_map(
    df: DataFrame,
    x: str = "cx",
    y: str = "cy",
    bins: int = FLOOD_BINS,
    limits: tuple[float, float] = FLOOD_RANGE,
    by: list[str] | None = None,
    passed: Column | None = None,
) -> DataFrame:
    """Counts per (group, x bin, y bin); with ``passed`` also the counts of the rows that satisfy it, in one pass."""
    by = by or []
    low, high = limits
    binned = df.select(
        *by,
        bin_index(x, low, high, bins).alias("bin_x"),
        bin_index(y, low, high, bins).alias("bin_y"),
        *([] if passed is None else [passed.alias("_passed")]),
    ).filter(F.col("bin_x").isNotNull() & F.col("bin_y").isNotNull())
    aggs = [F.count("*").alias("count")]
    if passed is not None:
        aggs.append(F.count_if("_passed").alias("count_passed"))
    return binned.groupBy(*by, "bin_x", "bin_y").agg(*aggs)


def projection(
    flood: DataFrame,
    axis: str = "y",
    by: list[str] | None = None,
    bins: int = FLOOD_BINS,
    limits: tuple[float, float] = FLOOD_RANGE,
) -> DataFrame:
    """Sum of a flood map over the other axis, with bin centres."""
    by = by or []
    summed = flood.groupBy(*by, F.col(f"bin_{axis}").alias("bin")).agg(F.sum("count").alias("count"))
    return summed.withColumn(
        "centre", centre(bin_low("bin", *limits, bins), bin_high("bin", *limits, bins))
    )


def projections(
    flood: DataFrame,
    by: list[str] | None = None,
    bins: int = FLOOD_BINS,
    limits: tuple[float, float] = FLOOD_RANGE,
) -> DataFrame:
    """Projections on both axes in one pass, told apart by the column ``axis``."""
    sides = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(f"bin_{a}").alias("bin_y")) for a in ("x", "y")])
    stacked = flood.select(*(by or []), "count", F.inline(sides))
    return projection(stacked, "y", [*(by or []), "axis"], bins, limits)


def module_summary(sides: DataFrame) -> DataFrame:
    """Per module (sm, mm): number of event sides, mean energy, mean depth, and mean position."""
    return sides.groupBy("sm", "mm").agg(
        F.count("*").alias("n_sides"),
        F.avg("module_energy").alias("mean_energy"),
        F.avg("depth").alias("mean_depth"),
        F.avg("cx").alias("mean_x"),
        F.avg("cy").alias("mean_y"),
    )


def near_maximum(hist: DataFrame, by: list[str] | None = None, cb: int = 8) -> DataFrame:
    """The bins of a histogram from ``cb`` below its (first) maximum up to, not including, ``cb`` above it.

    The window holds one histogram, never more rows than it has bins.
    """
    by = by or []
    w = Window.partitionBy(*(by or [F.lit(0)]))
    top = F.max(F.struct(F.col("count"), (-F.col("bin")).alias("b"))).over(w)
    peak = -top["b"]
    return (
        hist.withColumn("peak_bin", peak)
        .filter((F.col("bin") >= F.col("peak_bin") - cb) & (F.col("bin") < F.col("peak_bin") + cb))
        .withColumn("error", F.sqrt(F.col("count").cast("double")))
    )


def moments_around_maximum(hist: DataFrame, by: list[str] | None = None, cb: int = 8) -> DataFrame:
    """Per group: first maximum bin, count-weighted mean of the bin centres around it, and the summed count."""
    c = centre("lo", "hi")
    return (
        near_maximum(hist, by, cb)
        .groupBy(*(by or []), "peak_bin")
        .agg(
            F.try_divide(F.sum(c * F.col("count")), F.sum("count")).alias("mean"),
            F.sum("count").alias("total"),
        )
        .filter(F.col("total") > 0)
    )


def events_per_position(events: DataFrame, passed: Column | str, position: str = "position") -> DataFrame:
    """Passing events per scan position."""
    p = F.col(passed) if isinstance(passed, str) else passed
    return events.groupBy(position).agg(F.count_if(p).alias("n_events"))
