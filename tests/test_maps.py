from __future__ import annotations

import json
import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hitframe import maps
from hitframe.functions import electronics
from hitframe.maps.channel_map import Layout
from hitframe.maps.config import validated
from tests.conftest import SF
from workload import QUERIES


def description(**changes):
    raw = {
        "FEM": "FEM256",
        "FEBD": "FEBD8k",
        "mod_feb_map": {0: [2, 0, 3], 1: [0, 1, 15]},
        "x_pitch": 3.0,
        "y_pitch": 3,
        "mM_channels": 8,
        "sum_rows_cols": True,
        "Time": list(range(0, 256, 2)),
        "Energy": list(range(1, 256, 2)),
    }
    raw.update(changes)
    return {k: v for k, v in raw.items() if v is not None}


def by_channel(df):
    return {r["channel"]: r for r in df.collect()}


def test_row_column_map(spark):
    config = validated(description())
    built = by_channel(maps.configured_channel_map(spark, config))
    assert len(built) == config.rows == 512
    base = 131072 * 2 + 256 * 3
    first, second = built[base], built[base + 1]
    # First place: row 31, fine = 1.7025 + 3 * 0.205 + 31 * 3.2, coarse = 3.5 * 25.805.
    assert (first["x"], first["y"], first["slab"], first["mm"]) == (101.517, round(25.805 * 3.5, 3), 7, 0)
    assert (second["x"], second["y"], second["is_time"], second["is_energy"]) == (first["y"], first["x"], False, True)
    # Place 8 is minimodule 1; energy channels read the 4 x 4 grid by columns.
    assert built[base + 16]["mm"] == 1 and built[base + 17]["mm"] == 4
    other = 4096 + 256 * 15
    assert built[other]["sm"] == 1 and built[other]["mm_id"] == 1000
    assert (built[other]["port"], built[other]["slave"], built[other]["chip"]) == (0, 1, 60)


def test_straight_geometry_keeps_minimodules(spark):
    built = by_channel(maps.configured_channel_map(spark, validated(description()), geometry="straight"))
    base = 131072 * 2 + 256 * 3
    assert built[base + 16]["mm"] == built[base + 17]["mm"] == 1


def test_pixel_map_gives_the_second_list_the_next_module(spark):
    config = validated(
        description(
            FEM="FEM128", mM_channels=64, sum_rows_cols=False, Time=None, Energy=None,
            channels_j1=[5, 3, 9], channels_j2=[70, 80],
        )
    )
    built = by_channel(maps.configured_channel_map(spark, config))
    base = 131072 * 2 + 128 * 3
    assert sorted(c - base for c in built if c >= base) == [3, 5, 70, 80]
    assert [built[base + c]["mm"] for c in (5, 70)] == [0, 1]
    assert (built[base + 3]["x"], built[base + 3]["y"]) == (4.5, 1.5)
    assert built[base + 3]["slab"] is None and built[base + 3]["is_time"] and built[base + 3]["is_energy"]


def test_grid_positions():
    wide = Layout("FEM256", 3.1, 3.1, 64, False)
    assert wide.grid_position(17) == (round(1.5 * 3.1, 2), round(1.5 * 3.1, 2))
    summed = Layout("FEM256", 3.0, 3.0, 8, True)
    assert summed.grid_position(0) == (1.5, 94.5) and summed.grid_position(31) == (94.5, 1.5)
    small = Layout("FEM128", 3.0, 3.0, 8, True)
    assert small.grid_position(15) == (46.5, -22.5)


@pytest.mark.parametrize(
    "changes",
    [
        {"FEM": None},
        {"x_pitch": "3"},
        {"sum_rows_cols": 1},
        {"mM_channels": True},
        {"Time": None},
        {"channels_j1": [1], "channels_j2": [2]},
        {"FEM": "FEM64"},
        {"mod_feb_map": {0: [1, 2]}},
    ],
)
def test_bad_descriptions(changes):
    with pytest.raises(ValueError):
        validated(description(**changes))


def test_files(folder):
    path = os.path.join(folder, "map.json")
    with open(path, "w") as f:
        json.dump(description(), f)
    assert maps.load_config(path) == validated(description())
    run = os.path.join(folder, "run.json")
    with open(run, "w") as f:
        json.dump({"energy_range": [1, 200], "min_ch": 2, "en_min_ch": 0.2, "map_file": path}, f)
    assert maps.read_run_config(run) == {
        "energy_range": (1.0, 200.0), "min_ch": 2, "min_energy": 0.2, "map_file": path,
    }


def test_duplicates_are_found(spark):
    clash = validated(description(mod_feb_map={0: [0, 0, 1], 1: [0, 0, 1], 2: [0, 0, 2]}))
    built = maps.configured_channel_map(spark, clash)
    assert maps.duplicate_channels(built).count() == 256
    places = spark.createDataFrame([(0, 0, 0, 1), (1, 0, 0, 1), (2, 0, 0, 2)], "sm int, port int, slave int, febport int")
    found = maps.module_collisions(places, Layout("FEM256", 3.0, 3.0, 8, True)).collect()
    assert [tuple(r) for r in found] == [(256, 2)]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(0, 2**24 - 1))
def test_electronics_numbers_invert(spark, channel):
    rows = spark.range(1).select(F.lit(channel).alias("c"))
    numbers = rows.select("c", *electronics.electronics("c"))
    names = ("port", "slave", "chip", "chip_channel")
    assert numbers.select(electronics.absolute_id(*[F.col(n) for n in names])).first()[0] == channel


def test_listing(spark):
    built = maps.configured_channel_map(spark, validated(description()))
    listed = maps.channel_listing(built).collect()
    assert len(listed) == 8 and all(r["n_channels"] == 64 for r in listed)


def test_types_of_an_entry_are_its_own(spark):
    fields = "channel int, sm int, mm int, is_time boolean, is_energy boolean"
    entries = [(1, 0, 0, True, False), (1, 2, 3, False, True), (2, 0, 1, True, True), (3, 0, 1, False, False)]
    typed = maps.typed_module_ids(spark.createDataFrame(entries, fields))
    wanted = {(1, 0, "time"), (1, 2003, "energy"), (2, 1, "energy"), (2, 1, "time")}
    assert sorted(map(tuple, typed.collect())) == sorted(wanted)


def test_lookup_tables_join_nothing(spark, capsys):
    QUERIES["m11_lookup_tables"](spark, SF).explain()
    plan = capsys.readouterr().out
    assert "Generate" in plan and "Join" not in plan and "Exchange" not in plan
