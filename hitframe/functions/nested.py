"""Per-event features on the nested form: column expressions over the hit array of one side.

An event is one row, so nothing here shuffles, groups or depends on how events are distributed; sums follow the order
of hits. The channel map travels in the plan as short constant arrays: a channel id divided by the channels per front
end names the module, the remainder names the place in it. Their size is bounded by the id space of the electronics
and checked when they are built.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitframe.functions.electronics import PORT_CHANNELS, SLAVE_CHANNELS
from hitframe.maps.channel_map import constant_array, layout_of
from hitframe.maps.config import MapConfig
from hitframe.operators.features import weight

PLACES = "array<struct<mm:int,is_time:boolean,is_energy:boolean,x:double,y:double,slab:int>>"

# Largest module table carried inside a plan.
MAX_MODULE_SLOTS = 100_000


@dataclass(frozen=True)
class ChannelArrays:
    """Module number by front-end slot and the module template by channel remainder."""

    channels: int
    modules: list[int | None]
    places: list[tuple | None]

    @classmethod
    def of(cls, config: MapConfig, geometry: str = "transposed") -> ChannelArrays:
        slots: dict[int, int] = {}
        for sm, (port, slave, febport) in config.modules.items():
            base = port * PORT_CHANNELS + slave * SLAVE_CHANNELS + febport * config.channels
            if base // config.channels in slots:
                raise ValueError(f"two modules share the channels from {base}")
            slots[base // config.channels] = sm
        if max(slots) >= MAX_MODULE_SLOTS:
            raise ValueError("the module table is too large for a constant; use the channel map join")
        places: list = [None] * config.channels
        for entry in layout_of(config, geometry).template(config.first, config.second):
            if not 0 <= entry[0] < config.channels or places[entry[0]] is not None:
                raise ValueError(f"channel {entry[0]} is outside the front end or listed twice")
            places[entry[0]] = entry[1:]
        return cls(config.channels, [slots.get(i) for i in range(max(slots) + 1)], places)

    def enrich(self, hits: Column | str, unmapped: str = "fail") -> Column:
        """Hit array with module and ``place`` (minimodule, types, position, slab) of every channel.

        Unmapped hits are an error, or dropped or kept with NULLs on request.
        """
        bits = self.channels.bit_length() - 1
        if self.channels != 1 << bits:
            raise ValueError("channels per front end must be a power of two")
        slots = ",".join("NULL" if sm is None else str(sm) for sm in self.modules)
        modules = F.expr(f"array({slots})").cast("array<int>")
        places = F.expr(constant_array(self.places)).cast(PLACES)

        def describe(hit: Column) -> Column:
            sm = F.get(modules, F.shiftright(hit["channel"], bits))
            place = F.get(places, hit["channel"].bitwiseAND(self.channels - 1))
            return F.struct(
                hit["time"].alias("time"),
                hit["energy"].cast("double").alias("energy"),
                hit["channel"].alias("channel"),
                (sm * 1000 + place["mm"]).alias("mm_id"),
                place.alias("place"),
            )

        described = F.transform(F.col(hits) if isinstance(hits, str) else hits, describe)
        if unmapped == "keep":
            return described
        if unmapped == "drop":
            return F.filter(described, lambda h: h["mm_id"].isNotNull())
        unknown = F.exists(described, lambda h: h["mm_id"].isNull())
        return F.when(unknown, F.raise_error(F.lit("hit on a channel that is not in the map"))).otherwise(described)


def _sum(hits: Column, value) -> Column:
    return F.aggregate(hits, F.lit(0.0), lambda total, h: total + F.coalesce(value(h), F.lit(0.0)))


def _typed(kind: str | None):
    return (lambda h: F.lit(True)) if kind is None else (lambda h: h["place"][f"is_{kind}"])


def total_energy(hits: Column) -> Column:
    return _sum(hits, lambda h: F.when(h["place"]["is_energy"], h["energy"]))


def count(hits: Column, kind: str | None = None) -> Column:
    return F.size(hits) if kind is None else F.size(F.filter(hits, _typed(kind)))


def single_minimodule(hits: Column) -> Column:
    return F.size(F.array_distinct(F.transform(hits, lambda h: h["mm_id"]))) == 1


def strongest_module(hits: Column) -> Column:
    """Struct ``mm_id, energy``; modules are visited in order of their first hit, so the earliest wins ties."""
    modules = F.array_distinct(F.transform(hits, lambda h: h["mm_id"]))
    sums = F.transform(
        modules,
        lambda m: F.struct(
            m.alias("mm_id"),
            _sum(hits, lambda h: F.when((h["mm_id"] == m) & h["place"]["is_energy"], h["energy"])).alias("energy"),
        ),
    )
    # The greatest (energy, earliest visit) is the strongest; an empty side has none.
    return F.array_max(
        F.transform(
            sums, lambda s, i: F.struct(s["energy"].alias("energy"), (-i).alias("order"), s["mm_id"].alias("mm_id"))
        )
    )


def in_module(hits: Column, mm_id: Column) -> Column:
    return F.filter(hits, lambda h: h["mm_id"] == mm_id)


def strongest_hit(hits: Column, kind: str | None = None) -> Column:
    """Most energetic hit of a type, the earliest on ties, or NULL."""
    ranked = F.transform(
        F.filter(hits, _typed(kind)), lambda h, i: F.struct(h["energy"].alias("e"), (-i).alias("i"), h.alias("h"))
    )
    return F.array_max(ranked).getField("h")


def first_time_hit(hits: Column) -> Column:
    return F.get(F.filter(hits, _typed("time")), 0)


def dt_first(hits1: Column, hits2: Column) -> Column:
    """Time of the first time hit of side 1 minus that of side 2; NULL if a side has none."""
    return first_time_hit(hits1)["time"] - first_time_hit(hits2)["time"]


def coincidence(hits1: Column, hits2: Column, window: float) -> Column:
    """Struct of the most energetic time hit of each side and whether they are closer than the window (strict)."""
    first, second = strongest_hit(hits1, "time"), strongest_hit(hits2, "time")
    near = F.abs(first["time"] - second["time"]) < window
    return F.struct(
        first.alias("hit1"), second.alias("hit2"), F.coalesce(near, F.lit(False)).alias("coincident")
    )


def centroid(hits: Column, x_power: float = 1, y_power: float = 2, sum_rows_cols: bool = False) -> Column:
    """Struct ``cx, cy`` of energy-weighted positions."""

    def axis(name: str, power: float, kind: str | None) -> Column:
        def weighted(h: Column) -> Column:
            return weight(power, h["energy"])

        used = hits if kind is None else F.filter(hits, _typed(kind))
        return F.try_divide(_sum(used, lambda h: weighted(h) * h["place"][name]), _sum(used, weighted))

    return F.struct(
        axis("x", x_power, "time" if sum_rows_cols else None).alias("cx"),
        axis("y", y_power, "energy" if sum_rows_cols else None).alias("cy"),
    )


def depth_single(hits: Column) -> Column:
    energies = F.transform(F.filter(hits, _typed("energy")), lambda h: h["energy"])
    return F.try_divide(total_energy(hits), F.array_max(energies))


def depth_projected(hits: Column, axis: str = "x") -> Column:
    lines = F.array_distinct(F.transform(hits, lambda h: h["place"][axis]))
    sums = F.transform(lines, lambda c: _sum(hits, lambda h: F.when(h["place"][axis] == c, h["energy"])))
    return F.try_divide(_sum(hits, lambda h: h["energy"]), F.array_max(sums))


def sort_by_time(hits: Column) -> Column:
    """Ascending time, old order among equal times."""
    keyed = F.transform(hits, lambda h, i: F.struct(h["time"].alias("t"), i.alias("i"), h.alias("h")))
    return F.transform(F.array_sort(keyed), lambda k: k["h"])


def with_features(
    events: DataFrame,
    arrays: ChannelArrays,
    sum_rows_cols: bool = False,
    axis: str = "x",
    x_power: float = 1,
    y_power: float = 2,
    unmapped: str = "fail",
) -> DataFrame:
    """Events with the usual features of both sides, as structs ``f1`` and ``f2``; a narrow transformation.

    Fields: energy, n_hits, n_energy, single, mm_id, module_energy, cx, cy, depth, time.
    """

    def features(hits: Column) -> Column:
        strongest, position = strongest_module(hits), centroid(hits, x_power, y_power, sum_rows_cols)
        depth = depth_single(hits) if sum_rows_cols else depth_projected(hits, axis)
        return F.struct(
            total_energy(hits).alias("energy"),
            count(hits).alias("n_hits"),
            count(hits, "energy").alias("n_energy"),
            single_minimodule(hits).alias("single"),
            strongest["mm_id"].alias("mm_id"),
            strongest["energy"].alias("module_energy"),
            position["cx"].alias("cx"),
            position["cy"].alias("cy"),
            depth.alias("depth"),
            strongest_hit(hits, "time")["time"].alias("time"),
        )

    enriched = events.withColumns({s: arrays.enrich(s, unmapped) for s in ("side1", "side2")})
    return enriched.withColumns({f"f{i}": features(F.col(f"side{i}")) for i in (1, 2)})
