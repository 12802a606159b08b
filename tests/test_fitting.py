"""Column expressions of peak search and fits against the plain forms for one histogram."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from hitframe.functions import fitting
from hitframe.operators import fits


def arrays(spark, values):
    return spark.createDataFrame([(i, [float(v) for v in y]) for i, y in enumerate(values)], "i int, y array<double>")


@pytest.mark.parametrize("height,distance,prominence,width", [(1, 1, 1, 0), (3, 4, 2, 1), (2, 8, 1, 2.5)])
def test_peak_rules_in_columns(spark, height, distance, prominence, width):
    rng = np.random.default_rng(distance)
    values = [rng.integers(0, 8, rng.integers(1, 30)) for _ in range(150)] + [[0, 5, 0, 9, 0], [0, 4, 4, 4, 0], [3], [1, 1, 1], []]
    rows = arrays(spark, values).select("i", fitting.rightmost_peak(F.col("y"), F.lit(float(height)), distance, prominence, width).alias("k"))
    got = {r["i"]: r["k"] for r in rows.collect()}
    wanted = {i: fits.rightmost_peak(np.array(y, float), height, distance, prominence, width) if len(y) else None for i, y in enumerate(values)}
    assert got == wanted and any(k is not None for k in wanted.values())


def test_fit_in_columns_is_that_of_the_plain_form(spark):
    rng = np.random.default_rng(8)
    found = {}
    for g in range(6):
        found[g] = np.histogram(np.concatenate([rng.normal(30 + 6 * g, 2 + g / 2, 4000), rng.uniform(0, 100, 300)]), bins=100, range=(0, 100))[0]
    rows = [(g, b, int(c)) for g, counts in found.items() for b, c in enumerate(counts) if c]
    hist = spark.createDataFrame(rows, "g int, bin int, count long")
    for r in fits.fit_peaks(hist, ["g"], 100, (0.0, 100.0)).collect():
        plain = fits.fit_histogram(found[r["g"]].astype(float), np.arange(100) + 0.5)
        assert r["params"] == pytest.approx(plain["params"], rel=1e-6) and r["chi2_ndf"] == pytest.approx(plain["chi2_ndf"], rel=1e-6)
        assert np.array(r["covariance"]) == pytest.approx(np.array(plain["covariance"]), rel=1e-4)
        assert r["curve"] == pytest.approx(plain["curve"], rel=1e-6, abs=1e-9) and r["problem"] is None


def test_double_fit_finds_both_peaks_and_needs_no_python_worker(spark):
    rng = np.random.default_rng(2)
    counts = np.histogram(np.concatenate([rng.normal(44, 2, 20000), rng.normal(54, 3, 30000)]), bins=100, range=(0, 100))[0]
    hist = spark.createDataFrame([(0, b, int(c)) for b, c in enumerate(counts) if c], "g int, bin int, count long")
    fitted = fits.fit_peaks(hist, ["g"], 100, (0.0, 100.0), cb=16, model="double")
    assert fitted.first()["params"] == pytest.approx([20000, 44, 2, 30000, 54, 3], rel=0.03)
    plan = fitted._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_groups_without_a_fit_say_why(spark):
    rows = [(0, 5, 9), (1, 5, 900), (2, 5, 900), (2, 6, 800), (3, 0, 60), (3, 1, 70), (3, 2, 60), (3, 3, 1)]
    hist = spark.createDataFrame(rows, "g int, bin int, count long")
    got = {r["g"]: (r["params"] is None, r["problem"]) for r in fits.fit_peaks(hist, ["g"], 20, (0.0, 20.0)).collect()}
    assert got[0] == (True, "maximum below the required height") and got[1] == (True, "no width to fit")
    assert got[2] == (True, "no fit found") and got[3][0] is False
    assert fits.fit_peaks(hist.limit(0), ["g"], 20, (0.0, 20.0)).count() == 0
