"""Time skew, time differences between the two sides, and the coincidence window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitframe.operators.features import hit_columns, strongest_first
from hitframe.operators.lookups import small_side, with_skew
from hitframe.schema import EVENT, MAX_HITS_PER_SIDE, SIDE


def apply_skew(hits: DataFrame, skew: DataFrame, rows: int | None = None) -> DataFrame:
    """Subtract the channel's skew from the time of time hits; other hits keep their time.

    Times are 64-bit integers, so the whole part is subtracted as an integer and only the fraction as a double:
    ``time`` stays exact and ``time_fraction`` (0 <= f < 1) is what has to be added to it.
    """
    joined = with_skew(hits, skew, rows)
    shift = F.when(F.col("is_time"), F.col("skew")).otherwise(F.lit(0.0))
    whole = F.ceil(shift).cast("bigint")
    return joined.withColumns(
        {"time": F.col("time") - whole, "time_fraction": whole.cast("double") - shift}
    ).drop("skew")


def overlong_sides(hits: DataFrame, longest: int = MAX_HITS_PER_SIDE) -> DataFrame:
    """Event sides with more hits than an event file can hold, with their time range; normally none."""
    sizes = hits.groupBy(*SIDE).agg(
        F.count("*").alias("n_hits"), F.min("time").alias("first_time"), F.max("time").alias("last_time")
    )
    return sizes.filter(F.col("n_hits") > longest)


def sort_by_time(
    hits: DataFrame, overlong: DataFrame | None = None, overlong_rows: int = 0, slices: int = 1024
) -> DataFrame:
    """Renumber the hits of every side (from 0) by ascending time, keeping the old order among equal times.

    A side of an event file has at most 255 hits, so a window per side is enough. For other data pass the (written or
    checkpointed) ``overlong_sides`` with their number: those sides are cut into equal time slices that are numbered
    separately and then shifted by the hits of the slices before, so that no task sorts such a side alone.
    """
    if overlong is None or overlong_rows == 0:
        w = Window.partitionBy(*SIDE).orderBy("time", "hit_idx")
        return hits.withColumn("hit_idx", F.row_number().over(w) - 1)

    width = F.ceil((F.col("last_time") - F.col("first_time") + 1) / slices)
    cuts = small_side(overlong.select(*SIDE, F.col("first_time").alias("_start"), width.alias("_width")), overlong_rows)
    slice_ = F.floor((F.col("time") - F.col("_start")) / F.col("_width"))

    sliced = hits.join(cuts, SIDE, "left").withColumn("_slice", F.coalesce(slice_, F.lit(0)))
    w = Window.partitionBy(*SIDE, "_slice").orderBy("time", "hit_idx")
    numbered = sliced.withColumn("_rank", F.row_number().over(w) - 1)

    earlier = Window.partitionBy(*SIDE).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = hits.join(cuts, SIDE).groupBy(*SIDE, slice_.alias("_slice")).agg(F.count("*").alias("_n"))
    shifts = counts.select(*SIDE, "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    joined = numbered.join(small_side(shifts, overlong_rows * slices), [*SIDE, "_slice"], "left")
    number = (F.col("_rank") + F.coalesce("_shift", F.lit(0))).cast("int")
    return joined.select(*[number.alias(c) if c == "hit_idx" else F.col(c) for c in hits.columns])


def number_by_time(hits: DataFrame, every: int = 4096, cuts: int = 2048) -> DataFrame:
    """Renumber the hits of every side (from 0) by ascending time, keeping the old order among equal times.

    A side may have any number of hits, all at one time too. Some hits, chosen by a hash of their key, are cuts (time and ``hit_idx``) of
    their sides: one in ``every``, thinned to about ``cuts`` in all, so they can be broadcast and a part between two cuts is a small
    part of all hits. Parts are numbered apart and shifted by the hits of their side before them. Cuts and shifts
    depend on the data alone, so a task that runs again agrees with the others.
    Rows of a side that have both time and ``hit_idx`` in common are numbered in any order.
    """
    place = F.struct("time", "hit_idx")
    mark = F.xxhash64(*SIDE, "time", "hit_idx")
    chosen = hits.where(F.pmod(mark, F.lit(every)) == 0).select(*SIDE, place.alias("_cut"), F.floor(mark / every).alias("_mark"))
    thin = chosen.agg(F.greatest(F.ceil(F.count("*") / cuts), F.lit(1))).scalar()
    kept = chosen.where(F.pmod("_mark", thin) == 0)
    side_cuts = F.broadcast(kept.groupBy(*SIDE).agg(F.array_sort(F.collect_set("_cut")).alias("_cuts")))

    part = F.size(F.filter("_cuts", lambda cut: cut <= place))
    parted = hits.join(side_cuts, SIDE, "left").withColumn("_part", F.when(F.col("_cuts").isNull(), 0).otherwise(part)).drop("_cuts")
    w = Window.partitionBy(*SIDE, "_part").orderBy("time", "hit_idx")
    numbered = parted.withColumn("_rank", F.row_number().over(w) - 1)

    earlier = Window.partitionBy(*SIDE).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = hits.join(side_cuts, SIDE).groupBy(*SIDE, part.alias("_part")).agg(F.count("*").alias("_n"))
    shifts = counts.select(*SIDE, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    number = (F.col("_rank") + F.coalesce("_shift", F.lit(0))).cast("int")
    joined = numbered.join(F.broadcast(shifts), [*SIDE, "_part"], "left")
    return joined.select(*[number.alias(c) if c == "hit_idx" else F.col(c) for c in hits.columns])


def _side_value(side: int, value: Column) -> Column:
    return F.when(F.col("side") == side, value)


def dt_first(hits: DataFrame) -> DataFrame:
    """Per event: time of the first time hit of side 1 minus that of side 2; NULL if a side has none."""

    def first(side: int) -> Column:
        order = F.when((F.col("side") == side) & F.col("is_time"), F.col("hit_idx"))
        return F.min_by("time", order)

    return hits.groupBy(*EVENT).agg((first(1) - first(2)).alias("dt"))


def _first_time_hits(hits: DataFrame, n1: int, n2: int) -> DataFrame:
    """The first n1 / n2 time hits of side 1 / 2; the rank filter cuts each side before the shuffle."""
    if n1 < 1 or n2 < 1:
        raise ValueError("hit numbers start at 1")
    w = Window.partitionBy(*SIDE).orderBy("hit_idx")
    ranked = hits.filter(F.col("is_time")).withColumn("_rank", F.row_number().over(w))
    ranked = ranked.filter(F.col("_rank") <= max(n1, n2))
    return ranked.filter(F.col("_rank") <= F.when(F.col("side") == 1, n1).otherwise(n2))


def dt_weighted(hits: DataFrame, n1: int = 1, n2: int = 1) -> DataFrame:
    """Per event: energy-weighted mean time of the first hits of side 1 minus that of side 2.

    Times are taken relative to the event's earliest used hit, so the product with the energy keeps its precision.
    The window for it holds at most n1 + n2 rows.
    """
    used = _first_time_hits(hits, n1, n2)
    start = F.min("time").over(Window.partitionBy(*EVENT))
    used = used.withColumn("_t", (F.col("time") - start).cast("double"))

    def mean(side: int) -> Column:
        return F.try_divide(
            F.sum(_side_value(side, F.col("_t") * F.col("energy"))), F.sum(_side_value(side, F.col("energy")))
        )

    return used.groupBy(*EVENT).agg((mean(1) - mean(2)).alias("dt"))


def dt_nth(hits: DataFrame, skew: DataFrame, n1: int = 1, n2: int = 1, rows: int | None = None) -> DataFrame:
    """Per event: skew-corrected time of the n-th time hit (or the last) of side 1 minus side 2, and both energies."""
    used = with_skew(_first_time_hits(hits, n1, n2), skew, rows)
    last = F.col("_rank")

    def pick(side: int, column: str) -> Column:
        return F.max_by(column, _side_value(side, last))

    picked = used.groupBy(*EVENT).agg(
        *[pick(s, c).alias(f"{c}{s}") for s in (1, 2) for c in ("time", "skew", "energy")]
    )
    dt = (F.col("time1") - F.col("time2")).cast("double") - (F.col("skew1") - F.col("skew2"))
    return picked.select(*EVENT, dt.alias("dt"), "energy1", "energy2")


def coincidence(hits: DataFrame, window: float) -> DataFrame:
    """Per event: most energetic time hit of each side and whether they are closer than the window (strict)."""

    def strongest(side: int) -> Column:
        return F.min_by(hit_columns(), strongest_first((F.col("side") == side) & F.col("is_time")))

    pairs = hits.groupBy(*EVENT).agg(strongest(1).alias("hit1"), strongest(2).alias("hit2"))
    near = F.abs(F.col("hit1.time") - F.col("hit2.time")) < window
    return pairs.withColumn("coincident", F.coalesce(near, F.lit(False)))
