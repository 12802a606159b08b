"""Event predicates: boolean columns and the aggregates they are computed from.

Every aggregate is partial: a map task sends one row per event side (or event), so a single event that holds a large
share of all hits does not overload a reducer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from hitframe.schema import EVENT, MODULE, SIDE


def energy_window(energy: Column | str, low: float = 10.0, high: float = 100.0) -> Column:
    """Strictly inside the window."""
    e = F.col(energy) if isinstance(energy, str) else energy
    return (e > low) & (e < high)


def region_of_interest(
    x: Column | str, y: Column | str, x_range: tuple[float, float], y_range: tuple[float, float]
) -> Column:
    """Position strictly inside a rectangle."""
    return energy_window(x, *x_range) & energy_window(y, *y_range)


def enough_channels(n_energy: Column, n_hits: Column, min_ch: int, sum_rows_cols: bool = False) -> Column:
    """At least ``min_ch`` energy hits; with row/column readout also at least one hit of another type."""
    enough = n_energy >= min_ch
    return enough & (n_energy < n_hits) if sum_rows_cols else enough


def hit_threshold(hits: DataFrame, threshold: float) -> DataFrame:
    """Keep hits at or above the threshold."""
    return hits.filter(F.col("energy") >= threshold)


def side_counts(hits: DataFrame) -> DataFrame:
    """Per event side: all hits, energy hits, and the energy sum over hits of any type."""
    return hits.groupBy(*SIDE).agg(
        F.count("*").alias("n_hits"),
        F.count_if(F.col("is_energy")).alias("n_energy"),
        F.coalesce(F.sum("energy"), F.lit(0.0)).alias("all_energy"),
    )


def single_minimodule(hits: DataFrame) -> DataFrame:
    """Per event side: whether all hits lie in one minimodule (smallest id equals largest id)."""
    return hits.groupBy(*SIDE).agg((F.min("mm_id") == F.max("mm_id")).alias("single"))


def module_span(hits: DataFrame, level: str = "mm") -> DataFrame:
    """Per event: number of distinct modules over both sides, counted as minimodules or as supermodules."""
    column = {"mm": "mm_id", "sm": "sm"}[level]
    return hits.groupBy(*EVENT).agg(F.count_distinct(column).alias("n_modules"))


def touches_module(hits: DataFrame, sm: int, mm: int) -> DataFrame:
    """Per event: whether any hit of either side lies in module (sm, mm)."""
    return hits.groupBy(*EVENT).agg(F.bool_or((F.col("sm") == sm) & (F.col("mm") == mm)).alias("touches"))


def touching_any(hits: DataFrame, modules: DataFrame) -> DataFrame:
    """Events with a hit in any module of a table (sm, mm)."""
    return hits.join(modules.select(*MODULE), MODULE, "left_semi").select(*EVENT).distinct()


def in_channel_list(hits: DataFrame, channels: DataFrame) -> DataFrame:
    """Per event: whether all hits of side 1 or all hits of side 2 are in the list; an empty side counts as all."""
    listed = channels.select("channel").distinct().withColumn("_listed", F.lit(True))
    marked = hits.join(listed, "channel", "left").withColumn("_listed", F.coalesce("_listed", F.lit(False)))

    def all_of(side: int) -> Column:
        return F.coalesce(F.bool_and(F.when(F.col("side") == side, F.col("_listed"))), F.lit(True))

    return marked.groupBy(*EVENT).agg((all_of(1) | all_of(2)).alias("listed"))


def both_sides(sides: DataFrame, passed: Column | str) -> DataFrame:
    """Per event: side 1 and side 2 are both present and both pass."""
    p = F.col(passed) if isinstance(passed, str) else passed

    def passes(side: int) -> Column:
        return F.coalesce(F.bool_or((F.col("side") == side) & p), F.lit(False))

    return sides.groupBy(*EVENT).agg((passes(1) & passes(2)).alias("passed"))


def pair_sides(sides: DataFrame, columns: list[str], suffixes: tuple[str, str] = ("1", "2")) -> DataFrame:
    """One row per event with the chosen columns of both sides; a grouping, not a self-join."""
    aggs = [
        F.max(F.when(F.col("side") == side, F.col(c))).alias(f"{c}{suffix}")
        for side, suffix in zip((1, 2), suffixes)
        for c in columns
    ]
    return sides.groupBy(*EVENT).agg(*aggs)


def pass_counts(events: DataFrame, passed: Column | str, by: list[str] | None = None) -> DataFrame:
    """Events seen and events passing, overall or per group (per file, per run)."""
    p = F.col(passed) if isinstance(passed, str) else passed
    return events.groupBy(*(by or [])).agg(
        F.count("*").alias("total"), F.count_if(p).alias("passed")
    )


def observed(events: DataFrame, passed: Column | str, name: str = "events") -> tuple[DataFrame, Observation]:
    """The same two counters collected on the side while another action runs."""
    p = F.col(passed) if isinstance(passed, str) else passed
    seen = Observation(name)
    return events.observe(seen, F.count(F.lit(1)).alias("total"), F.count_if(p).alias("passed")), seen
