"""Aggregation per detector module: summaries, spectra, flood maps, moments, fits, scan positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from hitframe.operators import features, filters, fits, spectra
from hitframe.plans import coincidence
from workload.fit_sql import fit_ctes, fit_rows
from workload.fixtures import hits_a, table, with_views
from workload.registry import query

SIDES_SQL = """
, w AS (SELECT file_id, event_id, side, sum((energy + 0.00001::DOUBLE) * x) / sum(energy + 0.00001::DOUBLE) AS cx,
               sum(pow(energy + 0.00001::DOUBLE, 2) * y) / sum(pow(energy + 0.00001::DOUBLE, 2)) AS cy
        FROM ha GROUP BY ALL),
  l AS (SELECT file_id, event_id, side, x, sum(energy) AS e FROM ha GROUP BY ALL),
  d AS (SELECT file_id, event_id, side, sum(e) / max(e) AS depth, sum(e) AS energy FROM l GROUP BY ALL),
  sides AS (SELECT * FROM best_a JOIN w USING (file_id, event_id, side) JOIN d USING (file_id, event_id, side)),
  kept AS (SELECT event_id FROM sides WHERE module_energy > 10 AND module_energy < 100
           GROUP BY file_id, event_id HAVING count(*) = 2)
"""
SUMMARY_SQL = """SELECT sm, mm, count(*) AS n_sides, round(avg(module_energy), 6) AS mean_energy,
  round(avg(depth), 6) AS mean_depth, round(avg(cx), 6) AS mean_x, round(avg(cy), 6) AS mean_y
  FROM sides WHERE event_id IN (SELECT event_id FROM kept) GROUP BY sm, mm"""


def rounded_summary(summary):
    means = ["mean_energy", "mean_depth", "mean_x", "mean_y"]
    return summary.select("sm", "mm", "n_sides", *[F.round(c, 6).alias(c) for c in means])


@query("g01_module_summary", with_views("best_a", SIDES_SQL + SUMMARY_SQL))
def g01(spark, sf):
    return rounded_summary(coincidence.coincidence_modules(hits_a(spark, sf)))


def bin_sql(value: str, low: float, high: float, n: int) -> str:
    """Bin of a value, placed by scaling and corrected against the edges; NULL outside."""
    w = repr((high - low) / n)
    raw = f"least(floor(({value} - {low}::DOUBLE) * {n}::DOUBLE / {high - low}::DOUBLE), {n - 1})"
    return f"""CASE WHEN {value} BETWEEN {low} AND {high} THEN CAST({raw}
      - CASE WHEN {value} < {low}::DOUBLE + {raw} * {w}::DOUBLE THEN 1 ELSE 0 END
      + CASE WHEN {value} >= {low}::DOUBLE + ({raw} + 1) * {w}::DOUBLE AND {raw} <> {n - 1} THEN 1 ELSE 0 END
      AS INTEGER) END"""


def edges_sql(low: float, high: float, n: int) -> str:
    w = repr((high - low) / n)
    return f"""{low}::DOUBLE + bin * {w}::DOUBLE AS lo,
      CASE WHEN bin = {n - 1} THEN {high}::DOUBLE ELSE {low}::DOUBLE + (bin + 1) * {w}::DOUBLE END AS hi"""


PRICE_AXIS = (0.0, 500000.0, 250)


@query(
    "g02_histogram",
    f"""WITH b AS (SELECT {bin_sql("o_totalprice", *PRICE_AXIS)} AS bin FROM orders),
             c AS (SELECT bin, count(*) AS count FROM b WHERE bin IS NOT NULL GROUP BY bin)
        SELECT bin, count, {edges_sql(*PRICE_AXIS)}
        FROM (SELECT CAST(k AS INTEGER) AS bin, coalesce(count, 0) AS count
              FROM range(250) g(k) LEFT JOIN c ON bin = k)""",
)
def g02(spark, sf):
    low, high, n = PRICE_AXIS
    return spectra.histogram(table(spark, sf, "orders"), "o_totalprice", n, (low, high), fill=True)


@query(
    "g02_histogram_edges",
    f"""WITH b AS (SELECT {bin_sql("l_quantity", 1.0, 50.0, 49)} AS bin FROM lineitem)
        SELECT bin, count(*) AS count, {edges_sql(1.0, 50.0, 49)} FROM b WHERE bin IS NOT NULL GROUP BY bin""",
)
def g02_edges(spark, sf):
    return spectra.histogram(table(spark, sf, "lineitem"), "l_quantity", 49, (1.0, 50.0))


@query(
    "g02_histogram_events",
    f"""WITH b AS (SELECT event_type, {bin_sql("value", 0.0, 100.0, 250)} AS bin FROM events)
        SELECT event_type, bin, count(*) AS count, {edges_sql(0.0, 100.0, 250)}
        FROM b WHERE bin IS NOT NULL GROUP BY event_type, bin""",
)
def g02_events(spark, sf):
    return spectra.histogram(table(spark, sf, "events"), "value", by=["event_type"])


MODULE_HIST_SQL = f"""
, b AS (SELECT sm, mm, {bin_sql("module_energy", 0.0, 100.0, 250)} AS bin FROM best_a),
  c AS (SELECT sm, mm, bin, count(*) AS count FROM b WHERE bin IS NOT NULL GROUP BY ALL)
"""


def module_histogram(spark, sf):
    return spectra.histogram(features.strongest_module(hits_a(spark, sf)), "module_energy", by=["sm", "mm"])


@query(
    "g03_module_histograms",
    with_views("best_a", MODULE_HIST_SQL + f"SELECT sm, mm, bin, count, {edges_sql(0.0, 100.0, 250)} FROM c"),
)
def g03(spark, sf):
    return module_histogram(spark, sf)


FLOOD_SQL = f"""
, f AS (SELECT sm, mm, module_energy, {bin_sql("round(cx, 9)", 0.0, 26.0, 200)} AS bin_x,
               {bin_sql("round(cy, 9)", 0.0, 26.0, 200)} AS bin_y FROM sides)
"""


def placed_sides(spark, sf):
    """Side features with positions rounded to a nanometre, so that both engines agree at bin edges."""
    sides = coincidence.side_features(hits_a(spark, sf))
    return sides.withColumns({c: F.round(c, 9) for c in ("cx", "cy")})


@query(
    "g04_flood_map",
    with_views(
        "best_a",
        SIDES_SQL
        + FLOOD_SQL
        + "SELECT bin_x, bin_y, count(*) AS count FROM f WHERE bin_x IS NOT NULL AND bin_y IS NOT NULL GROUP BY ALL",
    ),
)
def g04(spark, sf):
    return spectra.flood_map(placed_sides(spark, sf))


@query(
    "g05_module_flood_maps",
    with_views(
        "best_a",
        SIDES_SQL
        + FLOOD_SQL
        + """SELECT sm, mm, bin_x, bin_y, count(*) AS count FROM f
             WHERE bin_x IS NOT NULL AND bin_y IS NOT NULL GROUP BY ALL""",
    ),
)
def g05(spark, sf):
    return spectra.flood_map(placed_sides(spark, sf), by=["sm", "mm"])


@query(
    "g06_projection",
    with_views(
        "best_a",
        SIDES_SQL
        + FLOOD_SQL
        + """SELECT 'x' AS axis, bin_x AS bin, count(*) AS count,
                    round(bin_x * 0.13::DOUBLE + 0.065::DOUBLE, 6) AS centre
             FROM f WHERE bin_x IS NOT NULL AND bin_y IS NOT NULL GROUP BY bin_x
             UNION ALL
             SELECT 'y', bin_y, count(*), round(bin_y * 0.13::DOUBLE + 0.065::DOUBLE, 6)
             FROM f WHERE bin_x IS NOT NULL AND bin_y IS NOT NULL GROUP BY bin_y""",
    ),
)
def g06(spark, sf):
    flood = spectra.flood_map(placed_sides(spark, sf))
    return spectra.projections(flood).select("axis", "bin", "count", F.round("centre", 6).alias("centre"))


@query(
    "g07_flood_map_in_window",
    with_views(
        "best_a",
        SIDES_SQL
        + FLOOD_SQL
        + """SELECT bin_x, bin_y, count(*) AS count,
                    count(*) FILTER (WHERE module_energy > 20 AND module_energy < 60) AS count_passed
             FROM f WHERE bin_x IS NOT NULL AND bin_y IS NOT NULL GROUP BY ALL""",
    ),
)
def g07(spark, sf):
    return spectra.flood_map(placed_sides(spark, sf), passed=filters.energy_window("module_energy", 20, 60))


@query(
    "g08_moments_around_maximum",
    with_views(
        "best_a",
        MODULE_HIST_SQL
        + """, p AS (SELECT sm, mm, bin AS peak_bin FROM c QUALIFY row_number() OVER (
                       PARTITION BY sm, mm ORDER BY count DESC, bin) = 1)
             SELECT sm, mm, peak_bin, round(sum((bin * 0.4::DOUBLE + 0.2::DOUBLE) * count) / sum(count), 6) AS mean,
                    CAST(sum(count) AS BIGINT) AS total
             FROM c JOIN p USING (sm, mm) WHERE bin >= peak_bin - 8 AND bin < peak_bin + 8 GROUP BY ALL""",
    ),
)
def g08(spark, sf):
    out = spectra.moments_around_maximum(module_histogram(spark, sf), ["sm", "mm"])
    return out.select("sm", "mm", "peak_bin", F.round("mean", 6).alias("mean"), "total")


def energy_histogram(spark, sf):
    """Side energies per module on a coarse axis, with a clear maximum."""
    sides = features.strongest_module(hits_a(spark, sf))
    return spectra.histogram(sides, "module_energy", 40, (0.0, 120.0), by=["sm", "mm"])


def fit_columns(fitted):
    p = F.col("params")
    return fitted.select(
        "sm", "mm", *[F.round(p[i], 3).alias(n) for i, n in enumerate(("area", "mean", "sigma"))],
        F.round("chi2_ndf", 3).alias("chi2_ndf"), "problem",
    )


def fit_query(**options) -> str:
    hist = f", hist AS (SELECT sm, mm, {bin_sql('module_energy', 0.0, 120.0, 40)} AS bin, count(*) AS count FROM best_a GROUP BY ALL)"
    return recursive(with_views("best_a", hist + fit_ctes("hist", 40, 0.0, 120.0, 20, **options) + "\n" + fit_rows()))


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query("g09_peak_fit", fit_query(finder="peak"))
def g09(spark, sf):
    hist = energy_histogram(spark, sf)
    return fit_columns(fits.fit_peaks(hist, ["sm", "mm"], 40, (0.0, 120.0), min_peak=20, finder="peak"))


@query("g10_gaussian_fit", fit_query())
def g10(spark, sf):
    hist = energy_histogram(spark, sf)
    return fit_columns(fits.fit_peaks(hist, ["sm", "mm"], 40, (0.0, 120.0), min_peak=20))


@query("g11_double_gaussian_fit", fit_query(count=2))
def g11(spark, sf):
    hist = energy_histogram(spark, sf)
    return fit_columns(fits.fit_peaks(hist, ["sm", "mm"], 40, (0.0, 120.0), min_peak=20, model="double"))


@query(
    "g12_photopeak_events",
    recursive(
        with_views(
            "ha",
            f""", e AS (SELECT event_id, sum(energy) FILTER (WHERE side = 1) AS energy1, sum(energy) FILTER (WHERE side = 2) AS energy2
                        FROM ha GROUP BY event_id),
              hist AS (SELECT 0 AS sm, 0 AS mm, {bin_sql("energy1", 0.0, 200.0, 50)} AS bin, count(*) AS count FROM e GROUP BY ALL)"""
            + fit_ctes("hist", 50, 0.0, 200.0, 20)
            + "SELECT event_id, energy1, energy2 FROM e, fitted WHERE energy1 > p[2] * 0.8::DOUBLE AND energy1 < p[2] * 1.2::DOUBLE",
        )
    ),
)
def g12(spark, sf):
    pairs = filters.pair_sides(features.total_energy(hits_a(spark, sf)), ["energy"])
    window = fits.photopeak_window(pairs, "energy1", bins=50, limits=(0.0, 200.0), min_peak=20)
    inside = pairs.filter(fits.in_photopeak(window))
    return inside.select("event_id", "energy1", "energy2")


@query(
    "g12_window_from_moments",
    with_views(
        "ha",
        f""", e AS (SELECT event_id, sum(energy) FILTER (WHERE side = 1) AS energy1 FROM ha GROUP BY event_id),
              c AS (SELECT {bin_sql("energy1", 0.0, 200.0, 50)} AS bin, count(*) AS count FROM e GROUP BY 1),
              p AS (SELECT bin AS top FROM c WHERE bin IS NOT NULL ORDER BY count DESC, bin LIMIT 1),
              m AS (SELECT sum((bin * 4 + 2) * count) / sum(count) AS mu FROM c, p WHERE bin >= top - 8 AND bin < top + 8)
            SELECT event_id, energy1 FROM e, m WHERE energy1 > 0.8::DOUBLE * mu AND energy1 < 1.2::DOUBLE * mu""",
    ),
)
def g12_moments(spark, sf):
    pairs = filters.pair_sides(features.total_energy(hits_a(spark, sf)), ["energy"])
    mean = spectra.moments_around_maximum(spectra.histogram(pairs, "energy1", 50, (0.0, 200.0)))
    window = mean.select((F.col("mean") * 0.8).alias("peak_low"), (F.col("mean") * 1.2).alias("peak_high"))
    return pairs.filter(fits.in_photopeak(window)).select("event_id", "energy1")


@query(
    "g13_events_per_position",
    with_views(
        "ha",
        """, n AS (SELECT event_id, coalesce(bool_and(c >= 2) AND count(*) = 2, false) AS passed
                   FROM (SELECT event_id, side, count(*) FILTER (WHERE is_energy) AS c FROM ha GROUP BY event_id, side)
                   GROUP BY event_id)
           SELECT CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS position,
                  count(*) FILTER (WHERE passed) AS n_events
           FROM orders JOIN n ON event_id = o_orderkey GROUP BY 1""",
    ),
)
def g13(spark, sf):
    sides = filters.side_counts(hits_a(spark, sf))
    passed = filters.both_sides(sides, filters.enough_channels(F.col("n_energy"), F.col("n_hits"), 2))
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("event_id"), F.substring("o_orderpriority", 1, 1).cast("int").alias("position")
    )
    return spectra.events_per_position(passed.join(orders, "event_id"), "passed")
