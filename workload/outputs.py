"""Result tables: training table, impact profile, list mode, event store, model inference."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from hitframe import sources
from hitframe.operators import features, filters, lookups, timing
from hitframe.operators.inference import predict_positions
from hitframe.plans import coincidence
from hitframe.session import scratch_path
from hitframe.sinks import tables as sinks
from hitframe.sources.events import to_hits
from workload.event_files import write_event_files
from workload.features import LAST_CELLS_SQL
from workload.fixtures import hits, hits_a, table, with_views
from workload.registry import query

LINE_SUMS = ", ".join(
    [f"coalesce(sum(energy) FILTER (WHERE floor(y / 3) = {k}), 0) AS col_{k}" for k in range(8)]
    + [f"coalesce(sum(energy) FILTER (WHERE floor(x / 3) = {k}), 0) AS row_{k}" for k in range(8)]
)


@query(
    "w01_training_table",
    with_views("hs_a", f"SELECT event_id, side, {LINE_SUMS}, mm, sm FROM hs_a GROUP BY event_id, side, mm, sm"),
)
def w01(spark, sf):
    return sinks.training_table(hits_a(spark, sf), 3.0).drop("file_id")


@query(
    "w01_training_table_any_supermodule",
    with_views(
        "best_a",
        f"""SELECT event_id, side, {LINE_SUMS}, h.mm, b.sm FROM ha h
            JOIN (SELECT event_id, side, sm, mm FROM best_a) b USING (event_id, side)
            WHERE h.mm = b.mm GROUP BY event_id, side, h.mm, b.sm""",
    ),
)
def w01_parity(spark, sf):
    return sinks.training_table(hits_a(spark, sf), 3.0, parity=True).drop("file_id")


@query(
    "w02_profile_lines",
    with_views(
        "ha",
        LAST_CELLS_SQL
        + """, c AS (SELECT * FROM cells WHERE side = 1),
             r AS (SELECT energy / max(energy) OVER (PARTITION BY file_id, event_id) AS share,
                          max(energy) OVER (PARTITION BY file_id, event_id) AS top,
                          row_number() OVER (PARTITION BY file_id, event_id ORDER BY energy DESC, row, col) AS rank
                   FROM c),
             s AS (SELECT rank, sum(share) AS share FROM r GROUP BY rank),
             n AS (SELECT count(*) AS n, sum(top) AS tops FROM r WHERE rank = 1)
             SELECT CAST(g.k AS INTEGER) AS line, round_even(coalesce(share, 0) / n, 3) AS value
             FROM range(1, 65) g(k) CROSS JOIN n LEFT JOIN s ON s.rank = g.k
             UNION ALL SELECT 0, round_even(tops / n, 3) FROM n""",
    ),
)
def w02(spark, sf):
    cells = features.impact_cells(hits_a(spark, sf).filter(F.col("side") == 1), 3.0)
    return sinks.profile_lines(features.impact_profile(cells))


def listmode_pairs(spark, sf, with_dt=True):
    """Coincidences with the fields of a list-mode record; the pair of supermodules is looked up in nations."""
    h = hits_a(spark, sf)
    pairs = coincidence.event_pairs(coincidence.side_features(h, first_time=with_dt))
    kept = pairs.filter(F.col("f1.sm").isNotNull() & F.col("f2.sm").isNotNull())
    dt = F.floor((F.col("f1.first_time") - F.col("f2.first_time")) / 10000000) if with_dt else F.lit(None)
    nation = table(spark, sf, "nation")
    pair_map = nation.select(
        (F.col("n_nationkey") * 10 + F.col("n_regionkey")).alias("p"),
        F.col("n_nationkey").alias("s0"),
        F.col("n_regionkey").alias("s1"),
    )
    flat = kept.select(
        "event_id",
        F.col("event_id").alias("time"),
        F.col("f1.energy").alias("energy1"),
        F.col("f2.energy").alias("energy2"),
        F.lit(1.0).alias("amount"),
        *[F.floor(F.round(F.col(f"f{i}.c{a}"), 9)).alias(f"{a}Position{i}") for i in (1, 2) for a in "xy"],
        *[F.floor(F.round(F.col(f"f{i}.depth") * 10, 9)).alias(f"zPosition{i}") for i in (1, 2)],
        F.col("f1.sm").alias("region1"),
        F.col("f2.sm").alias("region2"),
        dt.alias("dt"),
    )
    return lookups.with_pair(flat, pair_map)


def listmode_sql(version: str) -> str:
    fields = {
        "V3": "",
        "V4": ", CAST(floor(dt / 10000000) AS SMALLINT) AS dt",
        "V5": """, CAST(floor(dt / 10000000) AS SMALLINT) AS dt, CAST(floor(round(z1 * 10, 9)) AS TINYINT) AS zPosition1,
                 CAST(floor(round(z2 * 10, 9)) AS TINYINT) AS zPosition2""",
    }[version]
    return with_views(
        "best_a",
        f""", w AS (SELECT file_id, event_id, side, sum(energy) AS energy,
                           sum((energy + 0.00001::DOUBLE) * x) / sum(energy + 0.00001::DOUBLE) AS cx,
                           sum(pow(energy + 0.00001::DOUBLE, 2) * y) / sum(pow(energy + 0.00001::DOUBLE, 2)) AS cy
                    FROM ha GROUP BY ALL),
              l AS (SELECT file_id, event_id, side, x, sum(energy) AS e FROM ha GROUP BY ALL),
              d AS (SELECT file_id, event_id, side, sum(e) / max(e) AS depth FROM l GROUP BY ALL),
              f AS (SELECT file_id, event_id, side, min_by(time, hit_idx) AS t FROM ha GROUP BY ALL),
              s AS (SELECT * FROM best_a JOIN w USING (file_id, event_id, side) JOIN d USING (file_id, event_id, side)
                    JOIN f USING (file_id, event_id, side)),
              p AS (SELECT a.event_id, a.energy AS energy1, b.energy AS energy2, a.cx AS x1, a.cy AS y1, b.cx AS x2,
                           b.cy AS y2, a.depth AS z1, b.depth AS z2, a.t - b.t AS dt, a.sm AS r1, b.sm AS r2
                    FROM s a JOIN s b USING (file_id, event_id) WHERE a.side = 1 AND b.side = 2)
            SELECT CAST(event_id AS FLOAT) AS time, CAST(energy1 AS INTEGER) AS energy1,
                   CAST(energy2 AS INTEGER) AS energy2, CAST(1 AS FLOAT) AS amount,
                   CAST(floor(round(x1, 9)) AS TINYINT) AS xPosition1, CAST(floor(round(y1, 9)) AS TINYINT) AS yPosition1,
                   CAST(floor(round(x2, 9)) AS TINYINT) AS xPosition2, CAST(floor(round(y2, 9)) AS TINYINT) AS yPosition2,
                   n_nationkey * 10 + n_regionkey AS pair{fields}
            FROM p LEFT JOIN nation ON n_nationkey = r1 AND n_regionkey = r2""",
    )


@query("w03_listmode_v3", listmode_sql("V3"))
def w03(spark, sf):
    return sinks.listmode_table(listmode_pairs(spark, sf, with_dt=False), "V3")


@query("w04_listmode_v4", listmode_sql("V4"))
def w04(spark, sf):
    return sinks.listmode_table(listmode_pairs(spark, sf), "V4")


@query("w05_listmode_v5", listmode_sql("V5"))
def w05(spark, sf):
    return sinks.listmode_table(listmode_pairs(spark, sf), "V5")


#: What is given for the header of the fixture; ``rawCounts`` comes from the events.
HEADER_VALUES = {
    "identifier": "run", "acqTime": 60.0, "activity": 1.5, "isotope": "F18", "detectorSizeX": 103.22, "detectorSizeY": 103.22,
    "startTime": 12.25, "measurementTime": 60.0, "moduleNumber": 4, "ringNumber": 1, "ringDistance": 0.0, "detectorDistance": 410.5,
    "isotopeHalfLife": 6586.2, "weight": 70.5, "maxTemp": 25.0, "percentLoss": 0.25, "detectorPixelSizeX": 3.25, "detectorPixelSizeY": 3.25,
    "version": [5, 1], "breast": "L", "gatePeriod": 0.5, "DOILayer": 2, "method": 1, "StudyId": 77, "detectorPixelsX": 16, "detectorPixelsY": 8,
}
SQL_TYPES = {"string": "VARCHAR", "double": "DOUBLE", "int": "INTEGER", "float": "FLOAT", "smallint": "SMALLINT", "tinyint": "TINYINT"}


def header_sql() -> str:
    columns = ["CAST(count(*) AS DOUBLE) AS rawCounts"]
    for field in sinks.HEADER.split(", "):
        name, kind = field.split(" ")
        if name == "version":
            columns += [f"CAST({v} AS TINYINT) AS version_{k}" for k, v in enumerate(HEADER_VALUES[name])]
        elif name != "rawCounts":
            columns.append(f"CAST({HEADER_VALUES[name]!r} AS {SQL_TYPES[kind]}) AS {name}")
    return f"SELECT {', '.join(columns)} FROM (SELECT event_id FROM best_a GROUP BY file_id, event_id HAVING count(*) = 2)"


@query("w06_listmode_header", with_views("best_a", header_sql()))
def w06(spark, sf):
    sides = features.strongest_module(hits_a(spark, sf))
    both = filters.both_sides(sides, F.lit(True))
    header = sinks.listmode_header(both, F.col("passed"), **HEADER_VALUES)
    version = [F.col("version")[k].alias(f"version_{k}") for k in range(2)]
    return header.select(*[c for c in header.columns if c != "version"], *version)


@query(
    "w07_event_store",
    with_views(
        "hits",
        """SELECT CASE WHEN side = 1 THEN 'run_f' ELSE 'run_o' END AS run, count(*) AS n_hits, sum(energy) AS energy
           FROM hits GROUP BY 1""",
    ),
)
def w07(spark, sf):
    path = scratch_path(spark, "store")
    h = hits(spark, sf)
    for side, run in ((1, "run_f"), (2, "run_o")):
        sinks.store_events(h.filter(F.col("side") == side), path, run)
    return spark.read.parquet(path).groupBy("run").agg(F.count("*").alias("n_hits"), F.sum("energy").alias("energy"))


@query(
    "w07_event_store_runs",
    with_views(
        "hits",
        """, t AS (SELECT max(time) FILTER (WHERE side = 1 AND k = 1) - max(time) FILTER (WHERE side = 2 AND k = 1) AS dt
                   FROM (SELECT *, row_number() OVER (PARTITION BY event_id, side ORDER BY hit_idx) AS k FROM hits)
                   GROUP BY event_id)
           SELECT dt, count(*) AS n_events FROM (SELECT dt FROM t UNION ALL SELECT -dt FROM t) GROUP BY dt""",
    ),
)
def w07_runs(spark, sf):
    """Nested events of two runs with equal file names and event numbers; the second has its sides swapped, and is stored twice."""
    files, path = scratch_path(spark, "runs"), scratch_path(spark, "store")
    h = hits(spark, sf)
    sources.register(spark)
    for run, rows in (("run_f", h), ("run_b", h.withColumn("side", 3 - F.col("side")))):
        write_event_files(rows, f"{files}/{run}", "fixed")
    for run in ("run_f", "run_b", "run_b"):
        sinks.store_events(spark.read.format("fixed_events").load(f"{files}/{run}"), path, run)
    stored = to_hits(spark.read.parquet(path)).withColumn("is_time", F.lit(True))
    return timing.dt_first(stored).groupBy("dt").agg(F.count("*").alias("n_events"))


def linear_model():
    """Two linear outputs of 16 signals; the category shifts the first."""
    weights = np.arange(1, 17) / 16.0

    def predict(category_y, signals, category_depth):
        s = signals.astype(float)
        return s @ weights + category_y, s @ weights[::-1]

    return predict


SIGNALS = [f"{n}_{k}" for n in ("col", "row") for k in range(8)]
WEIGHTED = " + ".join(f"{c} * {k} / 16.0::DOUBLE" for k, c in enumerate(SIGNALS, 1))
WEIGHTED_BACK = " + ".join(f"{c} * {17 - k} / 16.0::DOUBLE" for k, c in enumerate(SIGNALS, 1))


@query(
    "x01_model_inference",
    with_views(
        "hs_a",
        f"""SELECT event_id, side, round({WEIGHTED} + mm, 4) AS local_y, round({WEIGHTED_BACK}, 4) AS depth
            FROM (SELECT event_id, side, {LINE_SUMS}, mm, sm FROM hs_a GROUP BY event_id, side, mm, sm)""",
    ),
)
def x01(spark, sf):
    """The model reads what the training table holds: the 16 line sums of each side's strongest module."""
    rows = sinks.training_table(hits_a(spark, sf), 3.0)
    rows = rows.select("event_id", "side", "mm", F.array(*[F.col(c).cast("double") for c in SIGNALS]).alias("signals"))
    out = predict_positions(rows, linear_model, category_y="mm")
    return out.select("event_id", "side", F.round("local_y", 4).alias("local_y"), F.round("depth", 4).alias("depth"))
