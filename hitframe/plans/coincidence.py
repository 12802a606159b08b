"""Whole analyses: coincidence spectra per module, photopeak and light spread, motor scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitframe.functions import nested
from hitframe.operators.features import (
    centroid_sums,
    colocate,
    divided,
    impact_cells,
    impact_profile,
)
from hitframe.operators.filters import energy_window, enough_channels, pair_sides
from hitframe.operators.fits import in_photopeak, photopeak_window
from hitframe.operators.spectra import events_per_position, flood_map, module_summary
from hitframe.schema import EVENT, MODULE, SIDE


def side_features(
    hits: DataFrame, axis: str = "x", x_power: float = 1, y_power: float = 2, placed: bool = False, first_time: bool = False
) -> DataFrame:
    """Per event side: counts, total energy, strongest module, centroid and projected depth in two shuffles.

    ``first_time`` adds the time of the side's first time hit, from the same groupings.

    The first grouping reduces hits to one row per (event side, module, line), whatever the share of an event is. One
    redistribution by event then serves the line window and the module, side and event groupings. ``placed`` says that
    the hits are already distributed by event (a table bucketed by it): then there is no shuffle.
    """
    e = F.when(F.col("is_energy"), F.col("energy"))
    at = F.when(F.col("is_time"), F.col("hit_idx"))
    starts = [F.min_by("time", at).alias("first_time"), F.min(at).alias("_at")] if first_time else []
    earliest = [F.min_by("first_time", "_at").alias("first_time"), F.min("_at").alias("_at")] if first_time else []
    lines = hits.groupBy(*SIDE, *MODULE, axis).agg(
        *starts,
        F.coalesce(F.sum(e), F.lit(0.0)).alias("_e"),
        F.sum("energy").alias("_all"),
        F.min("hit_idx").alias("_idx"),
        F.count("*").alias("_n"),
        F.count_if("is_energy").alias("_ne"),
        *centroid_sums(x_power, y_power, False),
    )
    # Rows of one event are now bounded by the channel map, so windows and groupings over it are small.
    line = Window.partitionBy(*SIDE, axis)
    lines = (lines if placed else colocate(lines)).withColumn("_line", F.sum("_all").over(line))
    sums = ["_sx", "_wx", "_sy", "_wy"]
    modules = lines.groupBy(*SIDE, *MODULE).agg(
        F.sum("_e").alias("module_energy"),
        F.min("_idx").alias("first_idx"),
        F.sum("_n").alias("_n"),
        F.sum("_ne").alias("_ne"),
        F.sum("_all").alias("_all"),
        F.max("_line").alias("_line"),
        *[F.sum(c).alias(c) for c in sums],
        *earliest,
    )
    order =F.struct((-F.col("module_energy")).alias("e"), F.col("first_idx").alias("i"))
    sides = modules.groupBy(*SIDE).agg(
        F.min_by(F.struct(*MODULE, "module_energy"), order).alias("_m"),
        F.sum("module_energy").alias("energy"),
        F.sum("_n").alias("n_hits"),
        F.sum("_ne").alias("n_energy"),
        F.sum("_all").alias("_all"),
        F.max("_line").alias("_line"),
        *[F.sum(c).alias(c) for c in sums],
        *earliest,
    )
    return sides.select(
        *SIDE,
        "n_hits",
        "n_energy",
        "energy",
        F.col("_m.sm").alias("sm"),
        F.col("_m.mm").alias("mm"),
        F.col("_m.module_energy").alias("module_energy"),
        divided(F.col("_sx"), F.col("_wx")).alias("cx"),
        divided(F.col("_sy"), F.col("_wy")).alias("cy"),
        divided(F.col("_all"), F.col("_line")).alias("depth"),
        *(["first_time"] if first_time else []),
    )


SIDE_VALUES = ["sm", "mm", "n_hits", "n_energy", "energy", "module_energy", "cx", "cy", "depth"]


def event_pairs(sides: DataFrame) -> DataFrame:
    """One row per event with a struct of features per side (NULL fields where a side has no hit)."""
    values = [*SIDE_VALUES, *(["first_time"] if "first_time" in sides.columns else [])]
    flat = pair_sides(sides, values)

    def side(k: int):
        return F.struct(*[F.col(f"{c}{k}").alias(c) for c in values]).alias(f"f{k}")

    return flat.select(*EVENT, side(1), side(2))


def in_both_windows(energy: tuple[float, float], field: str = "module_energy") -> Column:
    """Both sides of an event lie in the energy window."""
    return energy_window(F.col(f"f1.{field}"), *energy) & energy_window(F.col(f"f2.{field}"), *energy)


def both_in_window(pairs: DataFrame, energy: tuple[float, float]) -> DataFrame:
    """Events whose two sides both lie in the energy window."""
    return pairs.filter(in_both_windows(energy))


def stacked(pairs: DataFrame) -> DataFrame:
    """Both sides of every event as rows again."""
    return pairs.select(*EVENT, F.inline(F.array("f1", "f2")))


def coincidence_modules(hits: DataFrame, energy: tuple[float, float] = (10.0, 100.0)) -> DataFrame:
    """Per module: number, mean energy, depth and position of event sides of coincidences in the energy window."""
    return module_summary(stacked(both_in_window(event_pairs(side_features(hits)), energy)))


def coincidence_modules_nested(
    events: DataFrame, arrays: nested.ChannelArrays, energy: tuple[float, float] = (10.0, 100.0)
) -> DataFrame:
    """The same result from nested events: everything up to the module sums is a narrow transformation."""
    featured = nested.with_features(events, arrays).select(*EVENT, "f1", "f2")
    # The window is tested inside the outer generator, not by a filter below it: a filter would be pushed down to the
    # scan together with a second copy of all feature expressions.
    kept = F.when(in_both_windows(energy), F.array("f1", "f2"))
    sides = featured.select(*EVENT, F.inline_outer(kept)).filter(F.col("mm_id").isNotNull())
    split = {"sm": F.floor(F.col("mm_id") / 1000).cast("int"), "mm": (F.col("mm_id") % 1000).cast("int")}
    return module_summary(sides.withColumns(split))


def passing_pairs(hits: DataFrame, min_ch: int, sum_rows_cols: bool = False) -> DataFrame:
    """Events with enough energy channels on both sides."""
    pairs = event_pairs(side_features(hits))

    def enough(side: str):
        return enough_channels(F.col(f"{side}.n_energy"), F.col(f"{side}.n_hits"), min_ch, sum_rows_cols)

    return pairs.filter(enough("f1") & enough("f2"))


def light_spread(hits: DataFrame, pairs: DataFrame, pitch: float, n: int = 64) -> dict[str, DataFrame]:
    """Photopeak window of side 1, impact profile and flood map of the events inside it.

    ``pairs`` is read three times: pass a written table or a checkpoint of ``passing_pairs``.
    """
    energies = pairs.select(*EVENT, F.col("f1.energy").alias("energy1"), "f1.cx", "f1.cy")
    window = photopeak_window(energies)
    inside = in_photopeak(window)
    cells = impact_cells(hits.filter(F.col("side") == 1), pitch)
    return {
        "window": window,
        "profile": impact_profile(cells, energies.filter(inside), n),
        "flood": flood_map(energies.withColumn("inside", inside), passed=F.col("inside")),
    }


def motor_scan(events: DataFrame, position: str, min_ch: int, sum_rows_cols: bool = False) -> DataFrame:
    """Passing events per scan position from nested, enriched events: one scan of all files."""

    def enough(side: str):
        hits = F.col(side)
        return enough_channels(nested.count(hits, "energy"), nested.count(hits), min_ch, sum_rows_cols)

    return events_per_position(events, enough("side1") & enough("side2"), position)
