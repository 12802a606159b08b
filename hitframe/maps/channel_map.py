"""Building the channel map from module places and the channel positions of one module."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitframe.functions.electronics import PORT_CHANNELS, SLAVE_CHANNELS, electronics
from hitframe.maps.config import FRONT_ENDS, MapConfig
from hitframe.operators.lookups import small_side

# Fixed values of the row/column geometry in mm: crystal slab width, gap between minimodules, minimodule edge.
SLAB_WIDTH, MM_SPACING, MM_EDGE = 3.2, 0.205, 25.805
ROWS = 32


@dataclass(frozen=True)
class Layout:
    """What holds for every module: front-end type, pitches, minimodule size, readout and geometry.

    ``geometry`` is ``transposed`` (minimodule numbers of energy channels run down the columns of a 4 x 4 grid) or
    ``straight`` (same numbers for both types). It matters for row/column readout only.
    """

    fem: str
    x_pitch: float
    y_pitch: float
    mm_channels: int
    sum_rows_cols: bool
    geometry: str = "transposed"

    @property
    def channels(self) -> int:
        return FRONT_ENDS[self.fem][0]

    def energy_module(self, mm: int) -> int:
        """Minimodule number seen by energy channels: the 4 x 4 grid read by columns."""
        if self.geometry == "straight":
            return mm
        row, column = divmod(mm, 4)
        return column * 4 + row

    def grid_position(self, i: int) -> tuple[float, float]:
        """Position from the channel's place in the list, before any row/column geometry."""
        if self.fem == "FEM128":
            columns, digits = 8, None
        else:
            columns, digits = 16, 2
        if self.sum_rows_cols:
            # A row of sums has twice as many columns. The y index counts down from `top` and, on the smaller
            # front end, becomes negative for half of the places.
            place, top = i % (2 * columns), 7 if self.fem == "FEM128" else 31
            x, y = self.x_pitch / 2 + self.x_pitch * place, self.y_pitch / 2 + self.y_pitch * (top - place)
        else:
            x, y = (i % columns + 0.5) * self.x_pitch, (i // columns + 0.5) * self.y_pitch
        return (x, y) if digits is None else (round(x, digits), round(y, digits))

    def sum_position(self, i: int) -> tuple[float, float, int]:
        """Row/column readout: fine coordinate across slabs, coarse coordinate of the module row, slab number."""
        row = ROWS - 1 - i % ROWS
        fine = round((SLAB_WIDTH + MM_SPACING) / 2 + MM_SPACING * (row // 8) + SLAB_WIDTH * row, 3)
        coarse = round(MM_EDGE * (3.5 - i // ROWS), 3)
        return fine, coarse, row % self.mm_channels

    def place(self, i: int, offset: int, second: bool) -> tuple:
        """One entry of the module template: channel offset, minimodule, types, position, slab."""
        mm = i // self.mm_channels
        if not self.sum_rows_cols:
            return (offset, mm + 1 if second else mm, True, True, *map(float, self.grid_position(i)), None)
        fine, coarse, slab = self.sum_position(i)
        if second:
            return (offset, self.energy_module(mm), False, True, coarse, fine, slab)
        return (offset, mm, True, False, fine, coarse, slab)

    def template(self, first, second) -> list[tuple]:
        """All entries of one module; the shorter list decides how many pairs there are."""
        pairs = list(zip(first, second))
        return [self.place(i, o, s) for s in (False, True) for i, o in enumerate(p[s] for p in pairs)]


TEMPLATE_TYPE = (
    "array<struct<offset:int,mm:int,is_time:boolean,is_energy:boolean,x:double,y:double,slab:int>>"
)


def constant_array(entries: list[tuple | None]) -> str:
    """SQL text of a constant array of structs (or NULLs), parsed in one go."""

    def word(v) -> str:
        if v is None:
            return "NULL"
        return f"{v!r}D" if isinstance(v, float) else str(v).lower()

    structs = ["NULL" if e is None else f"struct({','.join(map(word, e))})" for e in entries]
    return f"array({','.join(structs)})"


def channel_map(modules: DataFrame, first, second, layout: Layout) -> DataFrame:
    """One row per channel from a table of module places (sm, port, slave, febport).

    The template of one module has at most as many entries as a front end has channels and travels inside the plan, so
    every module row expands in place: no join and no shuffle, however many modules there are.
    """
    template = F.expr(constant_array(layout.template(first, second))).cast(TEMPLATE_TYPE)
    base = (
        F.col("port") * PORT_CHANNELS + F.col("slave") * SLAVE_CHANNELS + F.col("febport") * layout.channels
    )
    expanded = modules.select("sm", base.alias("_base"), F.explode(template).alias("_t"))
    channel = (F.col("_base") + F.col("_t.offset")).cast("int")
    return expanded.select(
        channel.alias("channel"),
        F.col("sm").cast("int").alias("sm"),
        F.col("_t.mm").alias("mm"),
        (F.col("sm") * 1000 + F.col("_t.mm")).cast("int").alias("mm_id"),
        F.col("_t.is_time").alias("is_time"),
        F.col("_t.is_energy").alias("is_energy"),
        F.col("_t.x").alias("x"),
        F.col("_t.y").alias("y"),
        F.col("_t.slab").alias("slab"),
        *electronics(channel),
    )


def layout_of(config: MapConfig, geometry: str = "transposed") -> Layout:
    return Layout(
        config.fem, config.x_pitch, config.y_pitch, config.mm_channels, config.sum_rows_cols, geometry
    )


def configured_channel_map(
    spark: SparkSession, config: MapConfig, geometry: str = "transposed"
) -> DataFrame:
    """Channel map of a map description, hinted for broadcast within the proven row bound of the description."""
    modules = spark.createDataFrame(
        [(sm, *place) for sm, place in config.modules.items()], "sm int, port int, slave int, febport int"
    )
    built = channel_map(modules, config.first, config.second, layout_of(config, geometry))
    return small_side(built, config.rows)


def duplicate_channels(built: DataFrame) -> DataFrame:
    """Channels claimed more than once, with the number of claims; empty for a sound map."""
    return built.groupBy("channel").agg(F.count("*").alias("n_claims")).filter(F.col("n_claims") > 1)


def module_collisions(modules: DataFrame, layout: Layout) -> DataFrame:
    """First channels shared by several modules, with the number of modules; empty for a sound map."""
    base = (
        F.col("port") * PORT_CHANNELS + F.col("slave") * SLAVE_CHANNELS + F.col("febport") * layout.channels
    ).alias("first_channel")
    return modules.groupBy(base).agg(F.count("*").alias("n_modules")).filter(F.col("n_modules") > 1)


def channel_listing(built: DataFrame) -> DataFrame:
    """Channels with coordinates per (port, slave, chip); a chip has at most 64 channels in a sound map."""
    entry = F.struct("channel", "x", "y")
    return built.groupBy("port", "slave", "chip").agg(
        F.array_sort(F.collect_list(entry)).alias("channels"), F.count("*").alias("n_channels")
    )
