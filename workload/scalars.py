"""Calibration, model curves, slab categories, bins."""

from __future__ import annotations

from pyspark.sql import functions as F

from hitframe.functions import bins, calibration, curves, slab_system
from hitframe.operators import lookups
from workload.fixtures import hits_b, table, with_views
from workload.joins import MU_SQL, line_energies, mu_table
from workload.registry import query


def r6(column, alias: str):
    return F.round(column, 6).alias(alias)


@query(
    "k01_kev_from_peak",
    f"""WITH {MU_SQL}
        SELECT l_orderkey, l_partkey, round(CASE WHEN mu <> 0 THEN 511.0::DOUBLE / mu * l_quantity ELSE 0 END, 6) AS kev
        FROM lineitem JOIN mu ON id = l_suppkey""",
)
def k01(spark, sf):
    rows = lookups.with_calibration(line_energies(spark, sf), mu_table(spark, sf), ["id"])
    kev = calibration.kev_from_peak("energy", "mu")
    return rows.select("l_orderkey", F.col("part_id").alias("l_partkey"), r6(kev, "kev"))


@query(
    "k02_kev_from_polynomial",
    """SELECT l_orderkey, l_partkey,
              round(p_size / 1000.0::DOUBLE * l_quantity * l_quantity + p_retailprice / 1000 * l_quantity + 1.5::DOUBLE, 6)
                AS kev
       FROM lineitem JOIN part ON p_partkey = l_partkey""",
)
def k02(spark, sf):
    coefficients = table(spark, sf, "part").select(
        F.col("p_partkey").alias("part_id"),
        (F.col("p_size") / 1000.0).alias("c0"),
        (F.col("p_retailprice") / 1000).alias("c1"),
        F.lit(1.5).alias("c2"),
    )
    rows = lookups.with_calibration(line_energies(spark, sf), coefficients, ["part_id"])
    kev = calibration.kev_from_polynomial("energy", "c0", "c1", "c2")
    return rows.select("l_orderkey", F.col("part_id").alias("l_partkey"), r6(kev, "kev"))


@query(
    "k03_kev_by_slab",
    """WITH mu AS (SELECT p_partkey AS time_ch, CAST(p_size % 8 AS INTEGER) AS slab, p_retailprice AS mu FROM part)
       SELECT l_orderkey, l_partkey, l_linenumber, round(511.0::DOUBLE / mu * l_quantity, 6) AS kev
       FROM lineitem LEFT JOIN mu ON time_ch = l_partkey AND slab = l_linenumber""",
)
def k03(spark, sf):
    mu = table(spark, sf, "part").select(
        F.col("p_partkey").alias("time_ch"), (F.col("p_size") % 8).cast("int").alias("slab"), F.col("p_retailprice").alias("mu")
    )
    rows = line_energies(spark, sf).withColumnsRenamed({"part_id": "time_ch", "l_linenumber": "slab"})
    joined = lookups.with_calibration(rows, mu, ["time_ch", "slab"], "keep")
    kev = F.when(F.col("mu").isNotNull(), calibration.kev_from_peak("energy", "mu"))
    return joined.select(
        "l_orderkey", F.col("time_ch").alias("l_partkey"), F.col("slab").alias("l_linenumber"), r6(kev, "kev")
    )


@query(
    "k04_model_curves",
    """SELECT l_orderkey, l_partkey, l_linenumber,
         round(50 * exp(-0.5::DOUBLE * pow((l_quantity - 25) / 8.0::DOUBLE, 2)) / (8 * sqrt(2 * pi())), 6) AS gaussian,
         round(50 * exp(-0.5::DOUBLE * pow((l_quantity - 25) / 8.0::DOUBLE, 2)) / (8 * sqrt(2 * pi()))
             + 20 * exp(-0.5::DOUBLE * pow((l_quantity - 40) / 3.0::DOUBLE, 2)) / (3 * sqrt(2 * pi())), 6) AS double_gaussian,
         round(50 * 64 / (pow(l_quantity - 25, 2) + 64), 6) AS lorentzian
       FROM lineitem""",
)
def k04(spark, sf):
    x = "l_quantity"
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_linenumber",
        r6(curves.gaussian(x, 50, 25, 8), "gaussian"),
        r6(curves.double_gaussian(x, 50, 25, 8, 20, 40, 3), "double_gaussian"),
        r6(curves.lorentzian(x, 50, 25, 8), "lorentzian"),
    )


@query(
    "k05_slab_category",
    """SELECT l_orderkey, slab, slab AS cat_none, CAST(slab // 2 AS INTEGER) AS cat_sipm,
              CAST(slab // 16 AS INTEGER) AS cat_module, CAST(slab % 16 AS INTEGER) AS cat_position
       FROM (SELECT l_orderkey, CAST(l_partkey % 256 AS INTEGER) AS slab FROM lineitem)""",
)
def k05(spark, sf):
    system = slab_system.SYSTEMS["DEV-EB"]
    slab = (F.col("l_partkey") % system.total_slabs).cast("int")
    rows = table(spark, sf, "lineitem").select("l_orderkey", slab.alias("slab"))
    groupings = [
        slab_system.slab_category("slab", system, g).alias(f"cat_{g}") for g in ("none", "sipm", "module", "position")
    ]
    return rows.select("l_orderkey", "slab", *groupings)


@query(
    "k06_supermodule_position",
    with_views(
        "hb",
        """SELECT event_id, side, hit_idx, round(x, 6) AS sm_x, round(energy / 10 + y, 6) AS sm_y FROM hb""",
    ),
)
def k06(spark, sf):
    local_y = F.col("energy") / 10
    x, y = slab_system.supermodule_position(local_y, "x", "y")
    out = hits_b(spark, sf).select("event_id", "side", "hit_idx", x, y)
    return out.select("event_id", "side", "hit_idx", r6("sm_x", "sm_x"), r6("sm_y", "sm_y"))


@query(
    "k07_bin_centres",
    """SELECT l_orderkey, l_quantity, CAST(floor(l_quantity / 2.5::DOUBLE) AS INTEGER) AS bin,
              floor(l_quantity / 2.5::DOUBLE) * 2.5::DOUBLE + 1.25::DOUBLE AS centre
       FROM lineitem""",
)
def k07(spark, sf):
    axis = (0.0, 60.0, 24)
    b = bins.bin_index("l_quantity", *axis)
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", b.alias("bin"))
    centre = bins.centre(bins.bin_low("bin", *axis), bins.bin_high("bin", *axis))
    return rows.withColumn("centre", centre)


@query(
    "k05_categories_of_hits",
    with_views(
        "hb",
        """SELECT mm, CAST(slab AS INTEGER) AS position, count(*) AS n_hits, sum(energy) AS energy
           FROM (SELECT mm, (mm * 8 + slab) % 8 AS slab, energy FROM hb) GROUP BY ALL""",
    ),
)
def k05_hits(spark, sf):
    system = slab_system.SYSTEMS["DEV-IM"]
    index = F.col("mm") * system.slabs + F.col("slab")
    rows = hits_b(spark, sf).select("mm", slab_system.slab_category(index, system, "position").alias("position"), "energy")
    return rows.groupBy("mm", "position").agg(F.count("*").alias("n_hits"), F.sum("energy").alias("energy"))
