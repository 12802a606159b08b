"""Crystal slab of an event side, for one slab per time channel and for two slabs per time channel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitframe.operators.features import hit_columns, choose_strongest, per_module, strongest_first, top_hits
from hitframe.schema import MODULE, SIDE

# Fixed values of the light-sharing readout.
HALF_SLAB_WIDTH = 0.8
FIRST_POSITION, LAST_POSITION = 0, 7
FLAG_EDGE, FLAG_RANDOM, FLAG_UNRESOLVED, FLAG_NEIGHBOUR = 0, 1, 2, 3


def direct_slab(hits: DataFrame) -> DataFrame:
    """The most energetic time hit of the strongest module: its channel names the slab. NULLs when there is none."""
    modules = per_module(hits, F.min_by(hit_columns(), strongest_first(F.col("is_time"))).alias("_t"))
    picked = choose_strongest(modules, [*MODULE, "_t"])
    return picked.select(
        *SIDE,
        *MODULE,
        F.col("_t.channel").alias("slab_channel"),
        F.col("_t.time").alias("slab_time"),
        F.col("_t.energy").alias("slab_energy"),
    )


def _decide(interior: str, coin: Column) -> tuple[Column, Column, Column]:
    """Slab, flag and side of the channel centre (+1 / -1) from p, q (positions of the two strongest) and n (1 or 2)."""
    p, q, several = F.col("p"), F.col("q"), F.col("n") >= 2
    upper = p * 2 + 1
    lower = p * 2
    near_slab = {"batch": (upper, lower), "scalar": (lower, upper)}[interior]
    edge = p.isin(FIRST_POSITION, LAST_POSITION)
    far = F.abs(p - q) > 1
    inner = (p == FIRST_POSITION) == several

    flag = (
        F.when(p.isNull(), F.lit(None))
        .when(edge, FLAG_EDGE)
        .when(~several, FLAG_RANDOM)
        .when(far, FLAG_UNRESOLVED)
        .otherwise(FLAG_NEIGHBOUR)
    )
    shift = (
        F.when(edge, F.when(inner, 1).otherwise(-1))
        .when(~several, F.when(coin == 1, 1).otherwise(-1))
        .when(far, F.lit(None))
        .otherwise(F.when(p - q == 1, 1).otherwise(-1))
    )
    slab = (
        F.when(edge, F.when(shift == 1, upper).otherwise(lower))
        .when(~several, lower + coin)
        .when(far, F.lit(None))
        .otherwise(F.when(p - q == 1, near_slab[0]).otherwise(near_slab[1]))
    )
    return slab.cast("int"), flag.cast("int"), shift


def light_sharing_slab(
    hits: DataFrame, scope: str = "strongest", interior: str = "batch", seed: int = 0
) -> DataFrame:
    """Half-width slab from the two most energetic time hits.

    ``scope`` looks at the strongest module only or at ``all`` hits; ``interior`` picks which of two documented
    numberings applies when a neighbour decides. A lone interior hit is assigned to a half by a hash of the event key
    and ``seed``, so that a recomputed task gives the same answer.
    """
    key = [*SIDE, *MODULE] if scope == "strongest" else SIDE

    def at(rank: int, column: str) -> Column:
        return F.max(F.when(F.col("rank") == rank, F.col(column)))

    top = top_hits(hits, 2, "time", key).groupBy(*key).agg(
        at(1, "slab").alias("p"),
        at(1, "x").alias("_x"),
        at(1, "channel").alias("time_channel"),
        at(2, "slab").alias("q"),
        F.count("*").alias("n"),
    )
    if scope == "strongest":
        sides = choose_strongest(per_module(hits), MODULE)
    else:
        sides = hits.select(*SIDE).distinct()
    coin = F.pmod(F.xxhash64(F.lit(seed), *SIDE), F.lit(2)).cast("int")
    slab, flag, shift = _decide(interior, coin)
    return sides.join(top, key, "left").select(
        *key,
        slab.alias("slab"),
        flag.alias("flag"),
        (F.col("_x") + shift * F.lit(HALF_SLAB_WIDTH)).alias("slab_x"),
        "time_channel",
    )
