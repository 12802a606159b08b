"""Skew correction, time order and time differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from hitframe.operators import timing
from workload.fixtures import hits_a, hits_b, with_views
from workload.joins import SKEW_SQL, skew_table
from workload.registry import query


@query(
    "t01_apply_skew",
    with_views(
        "hb",
        SKEW_SQL
        + """, s AS (SELECT hb.*, CASE WHEN is_time THEN coalesce(skew, 0) ELSE 0 END AS shift
                     FROM hb LEFT JOIN skew USING (channel))
             SELECT event_id, side, hit_idx, time - CAST(ceil(shift) AS BIGINT) AS time,
                    round(ceil(shift) - shift, 6) AS time_fraction FROM s""",
    ),
)
def t01(spark, sf):
    out = timing.apply_skew(hits_b(spark, sf), skew_table(spark, sf))
    return out.select("event_id", "side", "hit_idx", "time", F.round("time_fraction", 6).alias("time_fraction"))


def time_ranked(n1: int, n2: int) -> str:
    return f""", r AS (SELECT *, row_number() OVER (PARTITION BY event_id, side ORDER BY hit_idx) AS k
                       FROM hb WHERE is_time),
                 u AS (SELECT * FROM r WHERE k <= CASE WHEN side = 1 THEN {n1} ELSE {n2} END)
            """


@query(
    "t02_dt_first",
    with_views(
        "hb",
        time_ranked(1, 1)
        + """SELECT e.event_id, max(time) FILTER (WHERE side = 1) - max(time) FILTER (WHERE side = 2) AS dt
             FROM (SELECT DISTINCT event_id FROM hb) e LEFT JOIN u USING (event_id) GROUP BY e.event_id""",
    ),
)
def t02(spark, sf):
    return timing.dt_first(hits_b(spark, sf)).select("event_id", "dt")


@query(
    "t03_dt_weighted",
    with_views(
        "hb",
        time_ranked(3, 2)
        + """, b AS (SELECT *, CAST(time - min(time) OVER (PARTITION BY event_id) AS DOUBLE) AS t FROM u)
             SELECT event_id, round(sum(t * energy) FILTER (WHERE side = 1) / sum(energy) FILTER (WHERE side = 1)
                    - sum(t * energy) FILTER (WHERE side = 2) / sum(energy) FILTER (WHERE side = 2), 3) AS dt
             FROM b GROUP BY event_id""",
    ),
)
def t03(spark, sf):
    out = timing.dt_weighted(hits_b(spark, sf), 3, 2)
    return out.select("event_id", F.round("dt", 3).alias("dt"))


@query(
    "t04_dt_nth",
    with_views(
        "hb",
        SKEW_SQL
        + time_ranked(2, 3)
        + """, v AS (SELECT u.*, coalesce(skew, 0) AS s FROM u LEFT JOIN skew USING (channel)
                     QUALIFY row_number() OVER (PARTITION BY event_id, side ORDER BY k DESC) = 1)
             SELECT event_id, max(time) FILTER (WHERE side = 1) - max(time) FILTER (WHERE side = 2)
                      - (max(s) FILTER (WHERE side = 1) - max(s) FILTER (WHERE side = 2)) AS dt,
                    max(energy) FILTER (WHERE side = 1) AS energy1, max(energy) FILTER (WHERE side = 2) AS energy2
             FROM v GROUP BY event_id""",
    ),
)
def t04(spark, sf):
    out = timing.dt_nth(hits_b(spark, sf), skew_table(spark, sf), 2, 3)
    return out.select("event_id", "dt", "energy1", "energy2")


@query(
    "t05_sort_by_time",
    with_views(
        "ha",
        """SELECT event_id, side, time, channel, energy,
                  CAST(row_number() OVER (PARTITION BY event_id, side ORDER BY time, hit_idx) - 1 AS INTEGER) AS hit_idx
           FROM ha""",
    ),
)
def t05(spark, sf):
    out = timing.number_by_time(hits_a(spark, sf))
    return out.select("event_id", "side", "time", "channel", "energy", "hit_idx")
