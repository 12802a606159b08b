"""Sources: tables are written as the files they stand for, by Spark tasks, and read back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from hitframe import sources
from hitframe.functions import nested
from hitframe.functions.nested import ChannelArrays
from hitframe.maps.config import validated
from hitframe.operators import filters
from hitframe.plans import coincidence
from hitframe.session import scratch_path
from hitframe.sources import tables
from hitframe.sources.events import position_of, to_hits
from hitframe.sources.split_index import split_index
from hitframe.streaming.ingest import append_to_table, landing_events
from workload.event_files import make_folder, published, write_event_files
from workload.fixtures import hits, table, with_views
from workload.joins import SKEW_SQL, skew_table
from workload.modules import SIDES_SQL, SUMMARY_SQL, rounded_summary
from workload.registry import query


def written(spark, sf, layout: str, **options) -> str:
    path = scratch_path(spark, f"{layout}-files")
    write_event_files(hits(spark, sf), path, layout, **options)
    sources.register(spark)
    return path


def side_energy(side: str):
    return F.aggregate(side, F.lit(0.0), lambda a, h: a + h["energy"].cast("double"))


def per_event(events):
    """Event contents without the id, which a file does not keep."""
    return events.select(
        F.size("side1").alias("n1"),
        F.size("side2").alias("n2"),
        side_energy("side1").alias("energy1"),
        side_energy("side2").alias("energy2"),
        F.get("side1", 0)["time"].alias("first_time1"),
        F.get("side2", 0)["time"].alias("first_time2"),
        F.get("side1", F.size("side1") - 1)["channel"].alias("last_channel1"),
    )


PER_EVENT_SQL = """
SELECT CAST(count(*) FILTER (WHERE side = 1) AS INTEGER) AS n1,
       CAST(count(*) FILTER (WHERE side = 2) AS INTEGER) AS n2,
       coalesce(sum(energy) FILTER (WHERE side = 1), 0) AS energy1,
       coalesce(sum(energy) FILTER (WHERE side = 2), 0) AS energy2,
       min_by(time, hit_idx) FILTER (WHERE side = 1) AS first_time1,
       min_by(time, hit_idx) FILTER (WHERE side = 2) AS first_time2,
       max_by(channel, hit_idx) FILTER (WHERE side = 1) AS last_channel1
FROM {hits} GROUP BY event_id
"""
COINCIDENCE_SQL = with_views("hits", PER_EVENT_SQL.format(hits="hits"))
GROUP_SQL = with_views(
    "hits",
    """SELECT CAST(count(*) AS INTEGER) AS n1, CAST(0 AS INTEGER) AS n2, sum(energy) AS energy1,
              CAST(0 AS DOUBLE) AS energy2,
              coalesce(min_by(time, hit_idx) FILTER (WHERE side = 1),
                       min_by(time, hit_idx) FILTER (WHERE side = 2)) AS first_time1,
              CAST(NULL AS BIGINT) AS first_time2,
              coalesce(max_by(channel, hit_idx) FILTER (WHERE side = 2),
                       max_by(channel, hit_idx) FILTER (WHERE side = 1)) AS last_channel1
       FROM hits GROUP BY event_id""",
)


@query("s01_compact_files", COINCIDENCE_SQL)
def s01(spark, sf):
    return per_event(spark.read.format("compact_events").load(written(spark, sf, "compact")))


@query("s02_compact_group_files", GROUP_SQL)
def s02(spark, sf):
    path = written(spark, sf, "compact", group=True)
    return per_event(spark.read.format("compact_events").option("group", "true").load(path))


@query("s03_fixed_files", COINCIDENCE_SQL)
def s03(spark, sf):
    path = written(spark, sf, "fixed")
    return per_event(spark.read.format("fixed_events").option("split_bytes", 1 << 20).load(path))


@query("s04_fixed_group_files", GROUP_SQL)
def s04(spark, sf):
    path = written(spark, sf, "fixed", group=True)
    return per_event(spark.read.format("fixed_events").option("group", "true").load(path))


@query("s05_compact_files_indexed", COINCIDENCE_SQL)
def s05(spark, sf):
    path, index = written(spark, sf, "compact"), scratch_path(spark, "split-index")
    split_index(spark, path, events_per_split=2000).write.parquet(index)
    return per_event(spark.read.format("compact_events").option("index", index).load(path))


@query(
    "s06_threshold_at_read",
    with_views(
        "hits",
        """, loud AS (SELECT * FROM hits WHERE energy >= 25)
           SELECT CAST(count(loud.energy) FILTER (WHERE loud.side = 1) AS INTEGER) AS n1,
                  CAST(count(loud.energy) FILTER (WHERE loud.side = 2) AS INTEGER) AS n2
           FROM (SELECT DISTINCT event_id FROM hits) e LEFT JOIN loud USING (event_id) GROUP BY event_id""",
    ),
)
def s06(spark, sf):
    events = spark.read.format("compact_events").option("min_energy", 25).load(written(spark, sf, "compact"))
    return events.select(F.size("side1").alias("n1"), F.size("side2").alias("n2"))


@query("s07_torn_files", COINCIDENCE_SQL)
def s07(spark, sf):
    """Every file ends in a torn record; dropping malformed events leaves exactly the whole ones."""
    path = written(spark, sf, "compact", tail=b"\x02\x01" + b"\x00" * 20)
    return per_event(spark.read.format("compact_events").option("mode", "dropmalformed").load(path))


@query(
    "s07_torn_events_reported",
    with_views(
        "hits",
        """SELECT false AS corrupt, count(DISTINCT event_id) AS n_events FROM hits
           UNION ALL SELECT true, 4""",
    ),
)
def s07_reported(spark, sf):
    path = written(spark, sf, "compact", tail=b"\x02\x01" + b"\x00" * 20, torn=4)  # four torn ends are counted
    events = spark.read.format("compact_events").load(path)
    return events.groupBy("corrupt").agg(F.count("*").alias("n_events"))


@query("s08_skew_file", ("WITH " + SKEW_SQL.lstrip(", ") + "SELECT channel, skew FROM skew"))
def s08(spark, sf):
    path = scratch_path(spark, "skew")
    line = F.concat_ws("   ", F.col("channel").cast("string"), F.col("skew").cast("string"))
    skew_table(spark, sf).select(line.alias("value")).write.text(path)
    return tables.read_skew(spark, path)


@query("s09_lor_skew_file", "SELECT CAST(s_suppkey AS INTEGER) AS pair, s_acctbal AS skew FROM supplier")
def s09(spark, sf):
    path = scratch_path(spark, "lor-skew")
    s = table(spark, sf, "supplier")
    s.select(F.col("s_suppkey").alias("Pair"), F.col("s_acctbal").alias("Skew")).write.csv(path, header=True)
    return tables.read_lor_skew(spark, path)


@query(
    "s10_pair_map_file",
    """SELECT CAST(s_suppkey AS INTEGER) AS p, s_nationkey AS s0, CAST(s_suppkey % 7 AS INTEGER) AS s1
       FROM supplier""",
)
def s10(spark, sf):
    path = scratch_path(spark, "pair-map")
    s = table(spark, sf, "supplier")
    s.select("s_suppkey", "s_nationkey", (F.col("s_suppkey") % 7).alias("s1")).write.csv(path, sep="\t")
    return tables.read_pair_map(spark, path)


@query("s11_calibration_file_mu", "SELECT CAST(s_suppkey AS INTEGER) AS id, s_acctbal AS mu FROM supplier")
def s11_mu(spark, sf):
    path = scratch_path(spark, "mu")
    s = table(spark, sf, "supplier")
    s.select(F.col("s_suppkey").alias("ID"), F.col("s_acctbal").alias("mu")).write.csv(path, sep="\t", header=True)
    return tables.read_calibration(spark, path, "mu")


@query(
    "s11_calibration_file_poly",
    """SELECT CAST(p_partkey AS INTEGER) AS id, p_size / 10.0::DOUBLE AS c0, p_retailprice AS c1,
              CAST(p_size AS DOUBLE) AS c2 FROM part""",
)
def s11_poly(spark, sf):
    path = scratch_path(spark, "poly")
    table(spark, sf, "part").select(
        F.col("p_partkey").alias("ID"),
        (F.col("p_size") / 10.0).alias("coef0"),
        F.col("p_retailprice").alias("coef1"),
        F.col("p_size").cast("double").alias("coef2"),
    ).write.csv(path, sep="\t", header=True)
    return tables.read_calibration(spark, path, "poly")


@query(
    "s11_calibration_file_slab",
    "SELECT CAST(p_partkey AS INTEGER) AS time_ch, p_size AS slab, p_retailprice AS mu FROM part",
)
def s11_slab(spark, sf):
    path = scratch_path(spark, "slab-mu")
    key = F.format_string("(%d, %d)", "p_partkey", "p_size").alias("ID(t_ch, slab)")
    table(spark, sf, "part").select(key, F.col("p_retailprice").alias("mu")).write.csv(path, sep="\t", header=True)
    return tables.read_calibration(spark, path, "slab")


@query(
    "s12_slab_category_file",
    "SELECT CAST(p_partkey AS INTEGER) AS slab_id, CAST(p_size - 20 AS INTEGER) AS category FROM part",
)
def s12(spark, sf):
    path = scratch_path(spark, "categories")
    make_folder(path)
    rows = table(spark, sf, "part").select(
        F.col("p_partkey").cast("int").alias("a"), (F.col("p_size") - 20).cast("int").alias("b")
    )

    def write(batches):
        name = f"{TaskContext.get().partitionId()}.bin"
        with published(path, name) as f:
            for batch in batches:
                words = np.stack([batch.column(c).to_numpy() for c in ("a", "b")], axis=1).astype("<i4")
                f.write(words.tobytes())
        yield pa.RecordBatch.from_pydict({"name": [name]})

    rows.mapInArrow(write, "name string").count()
    return tables.read_slab_categories(spark, path)


# The pixel fixture map as a map description: two modules, positions in channel order.
FIXTURE_MAP = validated(
    {
        "FEM": "FEM128",
        "FEBD": "none",
        "mod_feb_map": {0: [0, 0, 0], 1: [0, 0, 1]},
        "x_pitch": 3.0,
        "y_pitch": 3.0,
        "mM_channels": 64,
        "sum_rows_cols": False,
        "channels_j1": list(range(64)),
        "channels_j2": list(range(64, 128)),
    }
)


@query(
    "s13_positions_from_file_names",
    with_views(
        "hits",
        """, n AS (SELECT event_id, count(*) FILTER (WHERE side = 1) >= 2
                          AND count(*) FILTER (WHERE side = 2) >= 2 AS passed FROM hits GROUP BY event_id)
           SELECT CAST(event_id % 5 AS INTEGER) AS position, count(*) FILTER (WHERE passed) AS n_events
           FROM n GROUP BY 1""",
    ),
)
def s13(spark, sf):
    """Motor scan: one file set per position, position from the name, passing events per position."""
    path = scratch_path(spark, "scan")
    placed = hits(spark, sf).withColumn("position", (F.col("event_id") % 5).cast("int"))
    write_event_files(placed, path, "compact", by="position")
    sources.register(spark)
    events = spark.read.format("compact_events").load(path)
    arrays = ChannelArrays.of(FIXTURE_MAP)
    enriched = events.select(
        position_of("file_name").alias("position"), *[arrays.enrich(s).alias(s) for s in ("side1", "side2")]
    )
    return coincidence.motor_scan(enriched, "position", 2)


@query("g01_module_summary_nested", with_views("best_a", SIDES_SQL + SUMMARY_SQL))
def g01_nested(spark, sf):
    """The module summary from event files on the nested form: no shuffle before the module sums."""
    events = spark.read.format("fixed_events").load(written(spark, sf, "fixed"))
    return rounded_summary(coincidence.coincidence_modules_nested(events, ChannelArrays.of(FIXTURE_MAP)))


@query(
    "f10_counts_from_files",
    with_views(
        "hits",
        """SELECT count(DISTINCT event_id) AS total,
                  count(DISTINCT event_id) FILTER (WHERE event_id IN (
                    SELECT event_id FROM hits GROUP BY event_id HAVING count(DISTINCT side) = 2)) AS passed
           FROM hits""",
    ),
)
def f10_files(spark, sf):
    events = spark.read.format("compact_events").load(written(spark, sf, "compact"))
    return filters.pass_counts(events, (F.size("side1") > 0) & (F.size("side2") > 0))


@query(
    "s03_hits_from_files",
    with_views(
        "hits",
        """SELECT side, channel, count(*) AS n_hits, sum(energy) AS energy, min(time) AS first_time
           FROM hits GROUP BY side, channel""",
    ),
)
def s03_hits(spark, sf):
    long = to_hits(spark.read.format("fixed_events").load(written(spark, sf, "fixed")))
    return long.groupBy("side", "channel").agg(
        F.count("*").alias("n_hits"), F.sum("energy").alias("energy"), F.min("time").alias("first_time")
    )


@query("x02_incremental_ingest", COINCIDENCE_SQL)
def x02(spark, sf):
    """Landing files are streamed, two at a time, into a table; the table then holds every event once."""
    path = written(spark, sf, "fixed")
    out, log = scratch_path(spark, "landed"), scratch_path(spark, "landed-log")
    events = landing_events(spark, path, split_bytes=1 << 20, max_files_per_trigger=2)
    append_to_table(events, out, log).trigger(availableNow=True).start().awaitTermination()
    return per_event(spark.read.parquet(out))


@query(
    "a03_event_features_nested",
    with_views(
        "best_a",
        SIDES_SQL
        + """, c AS (SELECT file_id, event_id, side, count(*) AS n_hits, count(DISTINCT mm_id) = 1 AS single,
                            min_by(time, (-energy, hit_idx)) AS time FROM ha GROUP BY ALL)
             SELECT side, CAST(n_hits AS INTEGER) AS n_hits, energy, single, mm_id, module_energy, round(cx, 6) AS cx,
                    round(cy, 6) AS cy, round(depth, 6) AS depth, time
             FROM sides JOIN c USING (file_id, event_id, side)""",
    ),
)
def features_nested(spark, sf):
    """Features of every event side straight from event files, without any shuffle."""
    events = spark.read.format("fixed_events").load(written(spark, sf, "fixed"))
    featured = nested.with_features(events, ChannelArrays.of(FIXTURE_MAP))
    sides = F.array(*[F.struct(F.lit(k).alias("side"), F.col(f"f{k}").alias("f")) for k in (1, 2)])
    rows = featured.select(F.inline(sides)).select("side", "f.*").filter(F.col("n_hits") > 0)
    rounded = {c: F.round(c, 6) for c in ("cx", "cy", "depth")}
    return rows.withColumns(rounded).drop("n_energy")


@query(
    "t02_dt_first_nested",
    with_views(
        "hits",
        """SELECT count(*) AS n_hits, max(time) FILTER (WHERE side = 1 AND k = 1)
                  - max(time) FILTER (WHERE side = 2 AND k = 1) AS dt
           FROM (SELECT *, row_number() OVER (PARTITION BY event_id, side ORDER BY hit_idx) AS k FROM hits)
           GROUP BY event_id""",
    ),
)
def dt_first_nested(spark, sf):
    events = spark.read.format("compact_events").load(written(spark, sf, "compact"))
    arrays = ChannelArrays.of(FIXTURE_MAP)
    both = events.select(*[arrays.enrich(s).alias(s) for s in ("side1", "side2")])
    n_hits = (nested.count(F.col("side1")) + nested.count(F.col("side2"))).cast("bigint")
    return both.select(n_hits.alias("n_hits"), nested.dt_first(F.col("side1"), F.col("side2")).alias("dt"))


@query(
    "f08_coincidence_window_nested",
    with_views(
        "hits",
        """, t AS (SELECT * FROM hits QUALIFY row_number() OVER (
                     PARTITION BY event_id, side ORDER BY energy DESC, hit_idx) = 1)
           SELECT max(channel) FILTER (WHERE side = 1) AS channel1, max(channel) FILTER (WHERE side = 2) AS channel2,
                  coalesce(abs(max(time) FILTER (WHERE side = 1) - max(time) FILTER (WHERE side = 2)) < 50000000000,
                           false) AS coincident
           FROM t GROUP BY event_id""",
    ),
)
def coincidence_nested(spark, sf):
    events = spark.read.format("compact_events").load(written(spark, sf, "compact"))
    arrays = ChannelArrays.of(FIXTURE_MAP)
    both = events.select(*[arrays.enrich(s).alias(s) for s in ("side1", "side2")])
    out = nested.coincidence(F.col("side1"), F.col("side2"), 50_000_000_000)
    return both.select(out.alias("c")).select(
        F.col("c.hit1.channel").alias("channel1"), F.col("c.hit2.channel").alias("channel2"), "c.coincident"
    )
