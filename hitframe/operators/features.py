"""Per-event features of the long form.

All features are chains of ``groupBy`` whose partial aggregates merge, from (event, side, module) to (event, side).
``hit_idx`` is any orderable column giving the order of hits inside a side; it breaks every tie, the earliest hit wins.
If the input is already distributed by event (bucketed on ``event_id``) none of the groupings shuffles.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitframe.schema import EVENT, MODULE, SIDE

# Fixed value: added to every hit energy before it is used as a centroid weight.
WEIGHT_OFFSET = 0.00001


def divided(a: Column, b: Column, zero: str = "null") -> Column:
    """Ratio that is NULL, or 0 with ``zero="zero"``, when the denominator is 0 or missing."""
    ratio = F.try_divide(a, b)
    return F.coalesce(ratio, F.lit(0.0)) if zero == "zero" else ratio


def of_type(kind: str | None) -> Column:
    """Condition for a hit type: ``time``, ``energy`` or None for any."""
    return F.lit(True) if kind is None else F.col(f"is_{kind}")


def typed_sum(value: Column, condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0.0))


def strongest_first(condition: Column | None = None) -> Column:
    """Ordering key whose minimum is the most energetic hit, earliest first; NULL rows are not considered."""
    key = F.struct((-F.col("energy")).alias("e"), F.col("hit_idx").alias("i"))
    return key if condition is None else F.when(condition, key)


def hit_columns() -> Column:
    return F.struct("time", "energy", "channel")


def colocate(reduced: DataFrame) -> DataFrame:
    """Distribute rows by event once; later groupings and joins on the event or its sides then need no shuffle.

    Call it on data that is already reduced to one row per (event, side, module or line): the rows of one event are
    then bounded by the channel map, even if a single event holds a large share of all hits.
    """
    return reduced.repartition(*EVENT)


# --- totals -----------------------------------------------------------------------------------------------------


def total_energy(hits: DataFrame) -> DataFrame:
    """Per event side: energy sum and count of energy hits."""
    return hits.groupBy(*SIDE).agg(
        typed_sum(F.col("energy"), F.col("is_energy")).alias("energy"),
        F.count_if(F.col("is_energy")).alias("n_energy"),
    )


# --- strongest module -------------------------------------------------------------------------------------------


def per_module(hits: DataFrame, *aggregates: Column) -> DataFrame:
    """Per (event side, module): energy sum, position of the first hit, and any further aggregates."""
    return hits.groupBy(*SIDE, *MODULE).agg(
        typed_sum(F.col("energy"), F.col("is_energy")).alias("module_energy"),
        F.min("hit_idx").alias("first_idx"),
        *aggregates,
    )


def choose_strongest(modules: DataFrame, columns: list[str]) -> DataFrame:
    """Per event side: the chosen columns of the module with the largest energy sum, earliest hit on ties."""
    order = F.struct((-F.col("module_energy")).alias("e"), F.col("first_idx").alias("i"))
    picked = modules.groupBy(*SIDE).agg(F.min_by(F.struct(*columns), order).alias("_m"))
    return picked.select(*SIDE, *[F.col(f"_m.{c}").alias(c) for c in columns])


def strongest_module(hits: DataFrame) -> DataFrame:
    """Per event side: module with the largest energy sum and that sum."""
    return choose_strongest(per_module(hits), [*MODULE, "module_energy"])


def strongest_module_hits(hits: DataFrame) -> DataFrame:
    """All hits, of any type, that lie in the strongest module of their event side."""
    return hits.join(strongest_module(hits), [*SIDE, *MODULE])


# --- single hits ------------------------------------------------------------------------------------------------


def top_hits(hits: DataFrame, n: int, kind: str | None = "energy", by: list[str] | None = None) -> DataFrame:
    """The ``n`` most energetic hits of a type per event side, with their rank.

    The rank filter directly on the window lets Spark cut every group to ``n`` rows before the shuffle.
    """
    w = Window.partitionBy(*(by or SIDE)).orderBy(F.desc("energy"), "hit_idx")
    return hits.filter(of_type(kind)).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def strongest_hit(hits: DataFrame, kind: str | None = None) -> DataFrame:
    """Per event side: the most energetic hit of a type as a struct; NULL if the side has none."""
    return hits.groupBy(*SIDE).agg(F.min_by(hit_columns(), strongest_first(of_type(kind))).alias("hit"))


def module_time(hits: DataFrame, targets: DataFrame) -> DataFrame:
    """Per row of ``targets`` (event side, sm, mm): time of the most energetic time hit in that module, or NULL."""
    times = hits.groupBy(*SIDE, *MODULE).agg(
        F.min_by("time", strongest_first(F.col("is_time"))).alias("module_time")
    )
    return targets.join(times, [*SIDE, *MODULE], "left")


# --- centroid ---------------------------------------------------------------------------------------------------


def weight(power: float, energy: Column | None = None) -> Column:
    """Centroid weight of a hit; the usual powers 1 and 2 need no power function."""
    base = (F.col("energy") if energy is None else energy) + F.lit(WEIGHT_OFFSET)
    if power == 1:
        return base
    return base * base if power == 2 else F.pow(base, F.lit(float(power)))


def _library_power(base: float, power: float) -> float:
    try:
        return math.pow(base, power)
    except (OverflowError, ValueError):  # infinite, or not a number, as the C function has it
        return float(np.power(base, power))


def library_weights(hits: DataFrame, x_power: float, y_power: float) -> DataFrame:
    """Hits with the centroid weights ``_px``, ``_py`` by the C library's ``pow``, which Python's ``**`` and SQL engines call.

    Its last bit may differ from a product's, which decides where a position lies exactly on an edge.
    """

    def powered(power: float) -> Column:
        raised = F.pandas_udf(lambda base: pd.Series([_library_power(b, power) for b in base], dtype="float64"), "double")
        return weight(1) if power == 1 else F.when(F.col("energy").isNotNull(), raised(weight(1)))

    return hits.select("*", powered(x_power).alias("_px"), powered(y_power).alias("_py"))


def centroid_sums(
    x_power: float, y_power: float, sum_rows_cols: bool, weights: tuple[Column, Column] | None = None
) -> list[Column]:
    """Weighted sums of both axes; with row/column readout x uses time hits and y uses energy hits only."""
    use_x = F.col("is_time") if sum_rows_cols else F.lit(True)
    use_y = F.col("is_energy") if sum_rows_cols else F.lit(True)
    wx, wy = weights or (weight(x_power), weight(y_power))
    return [
        F.sum(F.when(use_x, wx * F.col("x"))).alias("_sx"),
        F.sum(F.when(use_x, wx)).alias("_wx"),
        F.sum(F.when(use_y, wy * F.col("y"))).alias("_sy"),
        F.sum(F.when(use_y, wy)).alias("_wy"),
    ]


def _centroid_columns(zero: str) -> list[Column]:
    return [
        divided(F.col("_sx"), F.col("_wx"), zero).alias("cx"),
        divided(F.col("_sy"), F.col("_wy"), zero).alias("cy"),
    ]


def centroid(
    hits: DataFrame,
    x_power: float = 1,
    y_power: float = 2,
    sum_rows_cols: bool = False,
    zero: str = "null",
    library_power: bool = False,
) -> DataFrame:
    """Per event side: energy-weighted position over all hits; with ``library_power`` to the last bit, see ``library_weights``."""
    weights = (F.col("_px"), F.col("_py")) if library_power else None
    weighted = library_weights(hits, x_power, y_power) if library_power else hits
    sums = weighted.groupBy(*SIDE).agg(*centroid_sums(x_power, y_power, sum_rows_cols, weights))
    return sums.select(*SIDE, *_centroid_columns(zero))


def _undecided(total: str, weights: str, size: str, edges: tuple[float, ...], digits: int) -> Column:
    """Whether sums in another order could give a ratio on another side of an edge, or another value rounded to ``digits``."""
    c = F.col(total) / F.col(weights)
    ulps = (F.col("_n") + 2) * F.lit(4 * 2.0**-53)
    error = ulps * (F.col(f"{size}x") + F.abs(c) * F.col(f"{size}w")) / F.abs(F.col(weights))
    scaled = F.abs(c) * 10.0**digits
    near = F.abs(scaled - F.floor(scaled) - 0.5) <= error * 10.0**digits
    for edge in edges:
        near = near | (F.abs(c - edge) <= error)
    return F.coalesce(near, F.lit(True))


def ordered_centroid(
    hits: DataFrame,
    order: list[str],
    x_edges: tuple[float, ...],
    y_edges: tuple[float, ...],
    digits: int,
    x_power: float = 1,
    y_power: float = 2,
) -> DataFrame:
    """Per event side: ``centroid`` with ``library_power``, with the sums of hits added one by one in ``order`` where that decides.

    Sums of floating-point numbers depend on their order, those of partial aggregates on how the rows lie in files and which task ends first. Where an
    order could move a position over one of the edges, or its value rounded to ``digits``, the hits of the side are added again by a running sum. These sides
    are broadcast: three hits or more, and within rounding error of an edge.
    """
    weighted = library_weights(hits, x_power, y_power)
    terms = {"_sx": F.col("_px") * F.col("x"), "_wx": F.col("_px"), "_sy": F.col("_py") * F.col("y"), "_wy": F.col("_py")}
    sizes = {"_axx": "_sx", "_axw": "_wx", "_ayx": "_sy", "_ayw": "_wy"}
    sums = weighted.groupBy(*SIDE).agg(
        F.count("*").alias("_n"),
        *[F.sum(term).alias(name) for name, term in terms.items()],
        *[F.sum(F.abs(terms[name])).alias(size) for size, name in sizes.items()],
    )
    undecided = _undecided("_sx", "_wx", "_ax", x_edges, digits) | _undecided("_sy", "_wy", "_ay", y_edges, digits)
    sums = sums.withColumn("_again", (F.col("_n") > 2) & undecided)  # two numbers have one sum
    sides = sums.filter("_again").select(*[F.col(c).alias(f"_{c}") for c in SIDE])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in SIDE]  # a side without a number is one too; no filter of nulls, so one exchange serves both
    again = hits.join(F.broadcast(sides), same, "left_semi")
    so_far = Window.partitionBy(*SIDE).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = library_weights(again, x_power, y_power).select(*SIDE, *order, *[F.sum(term).over(so_far).alias(name) for name, term in terms.items()])
    last = running.groupBy(*SIDE).agg(F.max_by(F.struct(*terms), F.struct(*order)).alias("_last")).select(*SIDE, "_last.*")
    return sums.filter("NOT _again").select(*SIDE, *terms).unionByName(last).select(*SIDE, *_centroid_columns("null"))


def strongest_centroid(
    hits: DataFrame, x_power: float = 1, y_power: float = 2, sum_rows_cols: bool = False, zero: str = "zero"
) -> DataFrame:
    """Per event side: energy-weighted position over the hits of the strongest module."""
    modules = per_module(hits, *centroid_sums(x_power, y_power, sum_rows_cols))
    picked = choose_strongest(modules, [*MODULE, "_sx", "_wx", "_sy", "_wy"])
    return picked.select(*SIDE, *MODULE, *_centroid_columns(zero))


# --- depth ------------------------------------------------------------------------------------------------------


def depth_single(hits: DataFrame, zero: str = "null") -> DataFrame:
    """Per event side: energy sum over the largest single energy hit (row/column readout)."""
    e = F.when(F.col("is_energy"), F.col("energy"))
    return hits.groupBy(*SIDE).agg(divided(F.sum(e), F.max(e), zero).alias("depth"))


def depth_projected(hits: DataFrame, axis: str = "x", zero: str = "null") -> DataFrame:
    """Per event side: energy sum over the largest sum of hits sharing one coordinate."""
    lines = hits.groupBy(*SIDE, axis).agg(F.sum("energy").alias("_line"))
    return lines.groupBy(*SIDE).agg(divided(F.sum("_line"), F.max("_line"), zero).alias("depth"))


def strongest_depth(
    hits: DataFrame, sum_rows_cols: bool = False, axis: str = "x", zero: str = "zero", placed: bool = False
) -> DataFrame:
    """Per event side: depth ratio over the energy hits of the strongest module.

    ``placed`` says that the hits are already distributed by event, as in a table bucketed by it.
    """
    e = F.when(F.col("is_energy"), F.col("energy"))
    if sum_rows_cols:
        modules = per_module(hits, F.max(e).alias("_peak"))
    else:
        lines = hits.groupBy(*SIDE, *MODULE, axis).agg(
            F.coalesce(F.sum(e), F.lit(0.0)).alias("_line"), F.min("hit_idx").alias("_idx")
        )
        modules = (lines if placed else colocate(lines)).groupBy(*SIDE, *MODULE).agg(
            F.sum("_line").alias("module_energy"),
            F.min("_idx").alias("first_idx"),
            F.max("_line").alias("_peak"),
        )
    picked = choose_strongest(modules, [*MODULE, "module_energy", "_peak"])
    return picked.select(*SIDE, *MODULE, divided(F.col("module_energy"), F.col("_peak"), zero).alias("depth"))


# --- impact matrix ----------------------------------------------------------------------------------------------


def matrix_side(channels: int, asics: int) -> int:
    """Boxes per side of the impact matrix: whole square root of channels per ASIC."""
    return int((channels / asics) ** 0.5)


def impact_cells(
    hits: DataFrame, pitch: float, y_pitch: float | None = None, combine: str = "last", total: bool = False
) -> DataFrame:
    """Per event side and matrix cell: energy of the last hit in it, or their sum with ``combine="sum"``.

    ``total`` adds the cell's sum over energy hits, so that an event's total can be had without another scan.
    """
    col = F.floor(F.col("x") / F.lit(float(pitch))).cast("int")
    row = F.floor(F.col("y") / F.lit(float(y_pitch or pitch))).cast("int")
    value = {"last": F.max_by("energy", "hit_idx"), "sum": F.sum("energy")}[combine]
    sums = [typed_sum(F.col("energy"), F.col("is_energy")).alias("total")] if total else []
    return hits.withColumns({"row": row, "col": col}).groupBy(*SIDE, "row", "col").agg(value.alias("energy"), *sums)


def impact_matrix(cells: DataFrame, side: int = 8) -> DataFrame:
    """Dense ``side`` x ``side`` matrix per event side, 0 where no hit fell; a cell outside it is an error."""
    inside = F.col("row").between(0, side - 1) & F.col("col").between(0, side - 1)
    checked = cells.filter(
        F.when(inside, True).otherwise(F.raise_error(F.lit("hit outside the impact matrix")).cast("boolean"))
    )

    # A side's cells, at most one per place, are listed and laid out afterwards: a group costs what it has, not a whole matrix.
    entry = F.struct((F.col("row") * side + F.col("col")).alias("place"), F.col("energy").alias("energy"))
    listed = checked.groupBy(*SIDE).agg(F.collect_list(entry).alias("_cells"))

    def cell(place: Column) -> Column:
        here = F.filter("_cells", lambda e: e["place"] == place)
        return F.coalesce(F.array_max(F.transform(here, lambda e: e["energy"])), F.lit(0.0))

    def row(r: Column) -> Column:
        return F.transform(F.sequence(r * side, r * side + (side - 1)), cell)

    return listed.select(*SIDE, F.transform(F.sequence(F.lit(0), F.lit(side - 1)), row).alias("matrix"))


def impact_profile(cells: DataFrame, events: DataFrame | None = None, n: int = 64) -> DataFrame:
    """Mean cell energy by rank, relative to the strongest cell, over the given events; and the mean maximum.

    ``cells`` holds the cells of one side, ``events`` the keys of the events to use (all by default). A group of the ranking window is
    one event's cells, at most one per matrix position. Ranks an event lacks count as 0. One row per rank 1..n; an event
    of more than ``n`` cells is an error.
    """
    used = cells if events is None else cells.join(events.select(*EVENT), EVENT, "left_semi")
    w = Window.partitionBy(*EVENT).orderBy(F.desc("energy"), "row", "col")
    whole = Window.partitionBy(*EVENT)
    ranked = used.withColumns({"_rank": F.row_number().over(w), "_max": F.max("energy").over(whole)})
    fits = F.when(F.col("_rank") <= n, True).otherwise(F.raise_error(F.lit(f"event with more than {n} cells")).cast("boolean"))
    ranked = ranked.filter(fits)
    per_rank = ranked.groupBy("_rank").agg(
        F.sum(F.try_divide(F.col("energy"), F.col("_max"))).alias("_share"), F.count("_max").alias("_k"), F.sum("_max").alias("_tops")
    )
    first = F.col("_rank") == 1
    sums = per_rank.agg(
        F.coalesce(F.max(F.when(first, F.col("_k"))), F.lit(0)).alias("_n"),
        F.max(F.when(first, F.col("_tops"))).alias("_sum_max"),
        F.map_from_entries(F.collect_list(F.struct("_rank", "_share"))).alias("_shares"),  # at most n entries
    )
    return sums.select("_n", "_sum_max", "_shares", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("rank")).select(
        "rank",
        F.bround(F.try_divide(F.coalesce(F.try_element_at("_shares", F.col("rank")), F.lit(0.0)), F.col("_n")), 3).alias("mean_share"),
        F.bround(F.try_divide(F.col("_sum_max"), F.col("_n")), 3).alias("mean_max"),
        F.col("_n").alias("n_events"),
    )


# --- neighbours -------------------------------------------------------------------------------------------------


def _with_anchor(hits: DataFrame) -> DataFrame:
    """Hits with the position ``_a`` of the most energetic energy hit of their side, joined by key, so a large side stays distributed."""
    anchor = F.struct(F.col("x").alias("ax"), F.col("y").alias("ay"))
    anchors = hits.groupBy(*SIDE).agg(F.min_by(anchor, strongest_first(F.col("is_energy"))).alias("_a"))
    return hits.join(anchors.filter(F.col("_a").isNotNull()), SIDE)


def _near_anchor(mode: int, x_pitch: float, y_pitch: float, axis: str) -> Column:
    dx, dy = F.abs(F.col("_a.ax") - F.col("x")), F.abs(F.col("_a.ay") - F.col("y"))
    along = {"x": (dx <= x_pitch) & (dy == 0), "y": (dy <= y_pitch) & (dx == 0)}
    if mode == 0:
        return along[axis]
    if mode == 1:
        return along["x"] | along["y"]
    return (dx <= x_pitch * (mode - 1)) & (dy <= y_pitch * (mode - 1))


def neighbour_hits(hits: DataFrame, mode: int, x_pitch: float, y_pitch: float, axis: str = "x") -> DataFrame:
    """Hits near the most energetic energy hit of their side.

    Mode 0: same line along ``axis`` within one pitch. Mode 1: the plus shape. Mode n >= 2: a square of half width
    (n - 1) pitches. All limits are inclusive.
    """
    return _with_anchor(hits).filter(_near_anchor(mode, x_pitch, y_pitch, axis)).drop("_a")


def neighbour_modes(hits: DataFrame, modes: dict[str, tuple[int, str]], x_pitch: float, y_pitch: float) -> DataFrame:
    """Neighbour hits of several modes, ``{name: (mode, axis)}``, from one join: a row per hit and ``mode`` that it's near by."""
    names = [F.when(_near_anchor(mode, x_pitch, y_pitch, axis), F.lit(name)) for name, (mode, axis) in modes.items()]
    return _with_anchor(hits).withColumn("mode", F.explode(F.array_compact(F.array(*names)))).drop("_a")
