from __future__ import annotations

import os
import random
import struct
import time

import pytest
from pyspark.sql import functions as F

from hitframe import sources
from hitframe.sources import tables
from hitframe.sources.compact import CompactReader, decode_bytes
from hitframe.sources.decode import file_number
from hitframe.sources.events import position_of, to_hits
from hitframe.sources.split_index import split_index
from hitframe.streaming.ingest import append_to_table, landing_events
from workload import event_files

EVENTS = [
    ([(1, 1.5, 10), (2, 2.5, 11)], [(3, 0.5, 20)]),
    ([], [(4, 4.0, 21)]),
    ([], []),
    ([(i, float(i), i) for i in range(255)], [(7, 7.0, 70)]),
    ([(1 << 60, -1.0, 5)], []),
]


def packed(hits) -> bytes:
    return b"".join(struct.pack("<qfi", *h) for h in hits)


def compact(events, group=False) -> bytes:
    if group:
        return b"".join(bytes([len(a)]) + packed(a) for a, _ in events)
    return b"".join(bytes([len(a), len(b)]) + packed(a) + packed(b) for a, b in events)


def fixed(events, limit, group=False) -> bytes:
    def side(hits):
        return packed(hits) + packed([(0, 0.0, -1)] * (limit - len(hits)))

    body = [
        bytes([len(a)]) + side(a) if group else bytes([len(a), len(b)]) + side(a) + side(b) for a, b in events
    ]
    return struct.pack("<i", limit) + b"".join(body)


def write(folder, name, data: bytes) -> str:
    with open(os.path.join(folder, name), "wb") as f:
        f.write(data)
    return folder


def read(spark, kind, path, **options):
    sources.register(spark)
    return spark.read.format(kind).options(**options).load(path)


def contents(df):
    rows = df.orderBy("file_name", "event_id").collect()
    return [tuple([tuple(h) for h in r[s]] for s in ("side1", "side2")) for r in rows]


@pytest.mark.parametrize("split", [1000, 8162, 9000, 1 << 20])
def test_fixed_round_trip_at_any_split(spark, folder, split):
    write(folder, "a.ldat", fixed(EVENTS, 255))
    got = read(spark, "fixed_events", folder, split_bytes=split)
    assert contents(got) == EVENTS
    assert [r["event_id"] for r in got.orderBy("event_id").collect()] == list(range(5))


def test_fixed_group_and_partial_record(spark, folder):
    events = [(a[:4], []) for a, _ in EVENTS]
    write(folder, "a.ldat", fixed(events, 4, group=True) + b"\x01abc")
    assert contents(read(spark, "fixed_events", folder, group="true")) == events
    with pytest.raises(Exception, match="ends inside a record"):
        read(spark, "fixed_events", folder, group="true", mode="failfast").collect()


def test_fixed_without_hits_and_short_files(spark, folder):
    write(folder, "a.ldat", fixed([([], [])] * 3, 0))
    write(folder, "b.ldat", b"\x01\x00")
    write(folder, "c.ldat", b"")
    assert contents(read(spark, "fixed_events", folder)) == [([], [])] * 3


def test_fixed_counter_above_the_limit_is_corrupt(spark, folder):
    data = bytearray(fixed([([(1, 1.0, 1)], [])], 2))
    data[4] = 9
    write(folder, "a.ldat", bytes(data))
    assert read(spark, "fixed_events", folder).first()["corrupt"]
    assert read(spark, "fixed_events", folder, mode="dropmalformed").count() == 0


def test_compact_round_trip(spark, folder):
    write(folder, "a.ldat", compact(EVENTS))
    write(folder, "b.ldat", compact(EVENTS[::-1]))
    assert contents(read(spark, "compact_events", folder)) == EVENTS + EVENTS[::-1]
    positive = contents(read(spark, "compact_events", folder, min_energy=0))
    assert positive[4] == ([], [])  # a threshold of 0 drops a negative energy
    assert positive[:4] == EVENTS[:4]


def test_compact_group(spark, folder):
    write(folder, "a.ldat", compact(EVENTS[:4], group=True))
    assert contents(read(spark, "compact_events", folder, group="true")) == [(a, []) for a, _ in EVENTS[:4]]


def test_threshold_is_inclusive_and_keeps_empty_events(spark, folder):
    write(folder, "a.ldat", compact(EVENTS[:2]))
    got = contents(read(spark, "compact_events", folder, min_energy=2.5))
    assert got == [([(2, 2.5, 11)], []), ([], [(4, 4.0, 21)])]


@pytest.mark.parametrize("every", [1, 2, 1000])
def test_split_index_gives_the_same_events(spark, folder, every):
    data, index = os.path.join(folder, "data"), os.path.join(folder, "index")
    os.mkdir(data)
    write(data, "a.ldat", compact(EVENTS[:4]))
    write(data, "b.ldat", compact(EVENTS[1:4]) + b"\x01\x02xyz")
    split_index(spark, data, events_per_split=every).write.parquet(index)
    whole = read(spark, "compact_events", data)
    indexed = read(spark, "compact_events", data, index=index)
    assert contents(indexed) == contents(whole)
    columns = ["file_name", "event_id", "corrupt"]
    assert sorted(indexed.select(columns).collect()) == sorted(whole.select(columns).collect())
    rows = spark.read.parquet(index).collect()
    assert len(rows) == {1: 7, 2: 4, 1000: 2}[every]
    assert sum(r["n_events"] for r in rows) == 7


def serial_index(name: str, data: bytes, every: int, sides: int) -> list[tuple]:
    """Splits as a plain walk from the first byte finds them."""
    starts, at = [], 0
    while at + sides <= len(data):
        behind = at + sides + 16 * sum(data[at : at + sides])
        if behind > len(data):
            break
        starts.append(at)
        at = behind
    cuts = [*range(0, max(len(starts), 1), every), len(starts)]
    places = [starts[c] if c < len(starts) else 0 for c in cuts[:-1]] + [len(data)]
    return [(name, len(data), places[i], places[i + 1], cuts[i], cuts[i + 1] - cuts[i]) for i in range(len(cuts) - 1)]


@pytest.mark.parametrize("group, fan", [(False, 2), (False, 64), (True, 3)])
def test_ranges_of_a_file_are_walked_apart_and_agree_with_a_serial_walk(spark, folder, group, fan):
    rng = random.Random(fan)
    sides = 1 if group else 2

    def events(n, most):
        return [tuple([(rng.getrandbits(60), rng.random(), rng.randrange(500)) for _ in range(rng.randrange(most + 1))] for _ in "ab") for _ in range(n)]

    files = {
        "long": compact(events(900, 20), group),
        "wide": compact(events(40, 255), group) + b"\xff",
        "torn": compact(events(300, 40), group) + bytes([250, 250]) + b"xyz" * 900,
        "zeros": bytes(30_001),
        "same": bytes([1]) * 40_000,
        "short": b"\x05",
        "empty": b"",
    }
    for name, data in files.items():
        write(folder, name, data)
    found = split_index(spark, folder, events_per_split=70, group=group, range_bytes=1, fan=fan)
    wanted = [r for name, data in files.items() if data for r in serial_index(f"{folder}/{name}", data, 70, sides)]
    assert sorted(tuple(r) for r in found.collect()) == sorted(wanted)
    whole = split_index(spark, folder, events_per_split=70, group=group)
    assert sorted(tuple(r) for r in whole.collect()) == sorted(wanted)


@pytest.mark.parametrize("most", [1, 3, 10_000])
def test_an_index_is_dealt_over_tasks_that_read_their_own_rows(spark, folder, most, monkeypatch):
    data, index = os.path.join(folder, "data"), os.path.join(folder, "index")
    os.mkdir(data)
    for name in "abc":
        write(data, f"{name}.ldat", compact(EVENTS * 4))
    split_index(spark, data, events_per_split=3).write.parquet(index)
    monkeypatch.setattr("hitframe.sources.compact.MOST_TASKS", most)
    whole = CompactReader({"path": data, "index": index})
    parts = whole.partitions()
    assert sum(p.count for p in parts) == 21 and len(parts) == 21 or most < 21
    assert sum(b.num_rows for p in parts for b in whole.read(p)) == 60
    one = CompactReader({"path": f"{data}/b.ldat", "index": index})
    assert sum(b.num_rows for p in one.partitions() for b in one.read(p)) == 20


def test_stale_index_is_refused(spark, folder):
    data, index = os.path.join(folder, "data"), os.path.join(folder, "index")
    os.mkdir(data)
    write(data, "a.ldat", compact(EVENTS[:2]))
    split_index(spark, data).write.parquet(index)
    write(data, "b.ldat", compact(EVENTS[:2]))
    with pytest.raises(Exception, match="does not cover"):
        read(spark, "compact_events", data, index=index).collect()


@pytest.mark.parametrize(
    "tail, wanted",
    [
        (bytes([2, 1]) + packed([(1, 1.0, 1)]), ([], [])),
        (bytes([1, 2]) + packed([(1, 1.0, 1)] * 2), ([(1, 1.0, 1)], [])),
        (bytes([1, 1]) + packed([(1, 1.0, 1)]) + b"abc", ([(1, 1.0, 1)], [])),
    ],
)
def test_torn_tail(spark, folder, tail, wanted):
    write(folder, "a.ldat", compact(EVENTS[:2]) + tail)
    got = read(spark, "compact_events", folder)
    assert contents(got) == EVENTS[:2] + [wanted]
    assert [r["corrupt"] for r in got.orderBy("event_id").collect()] == [False, False, True]
    assert read(spark, "compact_events", folder, mode="dropmalformed").count() == 2
    with pytest.raises(Exception, match="corrupt event"):
        read(spark, "compact_events", folder, mode="failfast").collect()


def test_torn_counter(spark, folder):
    write(folder, "a.ldat", compact(EVENTS[:2]) + b"\x05")
    assert contents(read(spark, "compact_events", folder)) == EVENTS[:2]


def test_long_form_keeps_hit_order(spark, folder):
    write(folder, "a.ldat", compact(EVENTS[:4]))
    long = to_hits(read(spark, "compact_events", folder))
    assert long.count() == 2 + 1 + 1 + 255 + 1
    first = long.filter((F.col("event_id") == 0) & (F.col("side") == 1)).orderBy("hit_idx").collect()
    assert [(r["hit_idx"], r["time"], r["energy"], r["channel"]) for r in first] == [(0, 1, 1.5, 10), (1, 2, 2.5, 11)]


@pytest.mark.parametrize("form", ["{}", "{}/", "file:{}", "file://{}", "{}/*.ldat", "{}/a.ldat"])
def test_path_forms(spark, folder, form):
    write(folder, "a.ldat", compact(EVENTS[:2]))
    write(folder, "_b.ldat", b"an unfinished file")
    assert contents(read(spark, "compact_events", form.format(folder))) == EVENTS[:2]


def test_missing_folder(spark, folder):
    with pytest.raises(Exception, match="nowhere"):
        read(spark, "compact_events", f"{folder}/nowhere").collect()


def test_a_folder_without_data_is_an_error(spark, folder):
    for layout in ("fixed_events", "compact_events"):
        with pytest.raises(Exception, match="no data files"):
            read(spark, layout, folder).collect()


def test_subfolders_are_read(spark, folder):
    import os

    for run in ("run=1", "run=2", "_temporary"):
        os.makedirs(f"{folder}/{run}")
        write(f"{folder}/{run}", "a.ldat", compact(EVENTS[:3]))
    assert read(spark, "compact_events", folder).count() == 6


def test_position_of_file_name(spark):
    names = [("scan_pos12_x.ldat",), ("pos-3.ldat",), ("a_b.ldat",), ("7pos_pos9.ldat",)]
    got = spark.createDataFrame(names, "n string").select(position_of("n")).collect()
    assert [r[0] for r in got] == [12, -3, None, 7]


@pytest.mark.parametrize("layout", ["fixed", "compact"])
def test_stream_takes_every_file_once(spark, folder, layout):
    data, out, log = (os.path.join(folder, n) for n in ("data", "out", "log"))
    os.mkdir(data)
    encode = (lambda e: fixed(e, 255)) if layout == "fixed" else compact

    def run():
        events = landing_events(spark, data, layout, split_bytes=5000)
        append_to_table(events, out, log).trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(out)

    write(data, "a.ldat", encode(EVENTS[:4]))
    assert contents(run()) == EVENTS[:4]
    write(data, "b.ldat", encode(EVENTS[:2]))
    got = run()
    assert got.count() == 6
    assert contents(got.filter("file_name = 'b.ldat'")) == EVENTS[:2]
    assert got.select("file_name", "event_id").distinct().count() == 6


def test_file_numbers_tell_paths_apart():
    paths = [f"/data/run{i // 1000}/file_{i % 1000}.ldat" for i in range(100_000)]
    assert len({file_number(p) for p in paths}) == len(paths)
    assert file_number("file:///data/a.ldat") == file_number("file:/data/a.ldat") == file_number("/data/a.ldat")
    assert file_number("s3a://b/a.ldat") == file_number("s3://b/a.ldat")


def test_events_keep_their_number_beside_other_files(spark, folder):
    write(folder, "b.ldat", fixed(EVENTS, 255))
    before = {r["file_id"] for r in read(spark, "fixed_events", folder).collect()}
    write(folder, "a.ldat", fixed(EVENTS, 255))
    after = read(spark, "fixed_events", folder)
    assert {r["file_id"] for r in after.filter("file_name = 'b.ldat'").collect()} == before
    assert after.select("file_id").distinct().count() == 2


def test_large_category_file_takes_linear_time(spark, folder):
    pairs = [(i - 50_000, -i) for i in range(100_000)]
    data = b"".join(struct.pack("<ii", *p) for p in pairs)
    for name, content in (("a.bin", data + b"\x01" * 7), ("b.bin", b""), ("c.bin", b"\x01" * 7), ("d.bin", data[:8])):
        with open(f"{folder}/{name}", "wb") as f:
            f.write(content)
    start = time.monotonic()
    got = [tuple(r) for r in tables.read_slab_categories(spark, folder).collect()]
    assert time.monotonic() - start < 60  # cuts of a text took minutes, each from its start
    assert sorted(got) == sorted([*pairs, pairs[0]])


def test_files_grow_in_number_and_only_the_torn_ones_get_the_tail(spark, folder, monkeypatch):
    monkeypatch.setattr(event_files, "FILE_HITS", 10)
    rows = [(e, side, 0, e, 1.0, 5) for e in range(50) for side in (1, 2)]
    h = spark.createDataFrame(rows, "event_id long, side int, hit_idx long, time long, energy double, channel int")
    event_files.write_event_files(h, f"{folder}/torn", "compact", tail=b"\x01", torn=2)
    data = [open(f"{folder}/torn/{n}", "rb").read() for n in sorted(os.listdir(f"{folder}/torn")) if not n.startswith(("_", "."))]
    assert len(data) == 10 and sum(len(d) % 34 == 1 for d in data) == 2 and sum(len(d) // 34 for d in data) == 50


def test_compact_files_are_decoded_in_small_pieces(folder):
    event = bytes([1, 1]) + packed([(1, 1.5, 10), (2, 2.5, 11)])
    with open(f"{folder}/a.ldat", "wb") as f:
        f.write(event * 150_000)
    sizes = [b.num_rows for b in decode_bytes(f"{folder}/a.ldat", 0, 0, len(event) * 150_000, 0, 2, None, "permissive")]
    assert sum(sizes) == 150_000 and max(sizes) <= 40_000
