from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hitframe.functions import bins, calibration, curves, slab_system
from hitframe.operators import fits, spectra


def values(spark, rows):
    return spark.createDataFrame([(float(v),) for v in rows], "v double")


@pytest.mark.parametrize("low, high, n", [(0.0, 26.0, 200), (0.0, 100.0, 250), (0.0, 1.0, 3), (-1.0, 1.0, 10)])
def test_bins_equal_numpy(spark, low, high, n):
    edges = np.linspace(low, high, n + 1)
    rng = np.random.default_rng(1)
    near = np.concatenate([edges, np.nextafter(edges, -9e9), np.nextafter(edges, 9e9), rng.uniform(low, high, 500)])
    got = values(spark, near).groupBy(bins.bin_index("v", low, high, n).alias("b")).count().collect()
    wanted, _ = np.histogram(near, bins=n, range=(low, high))
    counts = {r["b"]: r["count"] for r in got if r["b"] is not None}
    assert [counts.get(b, 0) for b in range(n)] == wanted.tolist()


def test_last_bin_is_closed_and_outside_dropped(spark):
    hist = spectra.histogram(values(spark, [0, 10, 10.1, -0.1, 5]), "v", 2, (0.0, 10.0), fill=True)
    assert [(r["bin"], r["count"], r["lo"], r["hi"]) for r in hist.orderBy("bin").collect()] == [
        (0, 1, 0.0, 5.0),
        (1, 2, 5.0, 10.0),
    ]


def test_projection_total_is_the_flood_map_total(spark):
    rng = np.random.default_rng(2)
    points = spark.createDataFrame([tuple(map(float, p)) for p in rng.uniform(-2, 28, (400, 2))], "cx double, cy double")
    flood = spectra.flood_map(points, bins=20)
    total = flood.agg(F.sum("count")).first()[0]
    inside = points.filter(F.col("cx").between(0, 26) & F.col("cy").between(0, 26)).count()
    assert total == inside
    both = spectra.projections(flood, bins=20)
    for axis in "xy":
        p = spectra.projection(flood, axis, bins=20)
        assert sorted(both.filter(F.col("axis") == axis).drop("axis").collect()) == sorted(p.collect())
        assert p.agg(F.sum("count")).first()[0] == total
        assert p.filter("bin = 0").first()["centre"] == pytest.approx(0.65)


def gaussian_counts(mean, sigma, area, n=100, high=100.0):
    centres = (np.arange(n) + 0.5) * high / n
    return np.round(area * np.exp(-0.5 * ((centres - mean) / sigma) ** 2) / (sigma * math.sqrt(2 * math.pi)))


def histogram_of(spark, groups: dict):
    rows = [(g, b, int(c)) for g, counts in groups.items() for b, c in enumerate(counts) if c]
    return spark.createDataFrame(rows, "g int, bin int, count bigint")


def test_fit_recovers_a_gaussian(spark):
    hist = histogram_of(spark, {1: gaussian_counts(42.3, 3.0, 50000), 2: gaussian_counts(60, 3, 200)})
    got = {r["g"]: r for r in fits.fit_peaks(hist, ["g"], 100, (0.0, 100.0)).collect()}
    area, mean, sigma = got[1]["params"]
    assert mean == pytest.approx(42.3, abs=0.01) and sigma == pytest.approx(3.0, abs=0.01)
    assert area == pytest.approx(50000, rel=0.01) and got[1]["chi2_ndf"] < 1
    assert len(got[1]["covariance"]) == 3 and len(got[1]["curve"]) == 100
    assert got[2]["params"] is None and "height" in got[2]["problem"]


def test_covariance_of_a_linear_case():
    """With many counts the error of the mean approaches sigma / sqrt(N), scaled by chi2 per degree of freedom."""
    rng = np.random.default_rng(3)
    counts, edges = np.histogram(rng.normal(50, 4, 200000), bins=100, range=(0, 100))
    out = fits.fit_histogram(counts.astype(float), (edges[1:] + edges[:-1]) / 2, cb=12)
    scale = math.sqrt(out["chi2_ndf"])
    assert math.sqrt(out["covariance"][1][1]) == pytest.approx(scale * 4 / math.sqrt(200000), rel=0.2)
    assert out["params"][1] == pytest.approx(50, abs=0.05)


def test_rightmost_good_peak_is_chosen(spark):
    two = gaussian_counts(30, 2.5, 40000) + gaussian_counts(70, 3, 30000)
    hist = histogram_of(spark, {0: two})
    by_peak = fits.fit_peaks(hist, ["g"], 100, (0.0, 100.0), finder="peak").first()["params"]
    by_max = fits.fit_peaks(hist, ["g"], 100, (0.0, 100.0), finder="max").first()["params"]
    assert by_peak[1] == pytest.approx(70, abs=0.05) and by_max[1] == pytest.approx(30, abs=0.05)


@pytest.mark.parametrize(
    "y, args, wanted",
    [
        ([0, 5, 0, 9, 0], (1, 1, 1, 0), 3),
        ([0, 5, 0, 3, 0], (4, 1, 1, 0), 1),
        ([0, 9, 8, 8.5, 0], (1, 1, 2, 0), 1),
        ([0, 9, 0, 5, 0], (1, 3, 1, 0), 1),
        ([0, 4, 4, 4, 0], (1, 1, 1, 0), 2),
        ([0, 1, 2, 3], (1, 1, 1, 0), None),
        ([0, 9, 0, 0, 0], (1, 1, 1, 2), None),
        ([0, 5, 9, 5, 0], (1, 1, 1, 2), 2),
    ],
)
def test_peak_rules(y, args, wanted):
    assert fits.rightmost_peak(np.array(y, float), *args) == wanted


def test_double_gaussian_fit_improves_on_one(spark):
    blend = gaussian_counts(48, 2, 20000) + gaussian_counts(53, 4, 30000)
    hist = histogram_of(spark, {0: blend})
    one = fits.fit_peaks(hist, ["g"], 100, (0.0, 100.0), cb=14).first()
    two = fits.fit_peaks(hist, ["g"], 100, (0.0, 100.0), cb=14, model="double").first()
    assert len(two["params"]) == 6 and two["chi2_ndf"] < one["chi2_ndf"]


def test_half_bin_option_shifts_the_mean(spark):
    hist = histogram_of(spark, {0: gaussian_counts(40, 3, 50000)})
    right = fits.fit_peaks(hist, ["g"], 100, (0.0, 100.0)).first()["params"][1]
    high = fits.fit_peaks(hist, ["g"], 100, (0.0, 100.0), legacy_half_bin=True).first()["params"][1]
    assert high - right == pytest.approx(0.5, abs=0.01)


def test_photopeak_window_selects_events(spark):
    rng = np.random.default_rng(4)
    energies = np.concatenate([rng.normal(100, 8, 4000), rng.uniform(0, 200, 500)])
    events = spark.createDataFrame([(float(e),) for e in energies], "energy1 double")
    window = fits.photopeak_window(events)
    row = window.first()
    assert row["mu"] == pytest.approx(100, abs=1) and row["peak_high"] == pytest.approx(1.2 * row["mu"])
    n = events.filter(fits.in_photopeak(window)).count()
    assert n == int(((energies > row["peak_low"]) & (energies < row["peak_high"])).sum())


def test_moments_around_the_first_maximum(spark):
    counts = [0] * 30
    counts[3], counts[10], counts[20] = 5, 9, 9
    hist = spectra.with_edges(histogram_of(spark, {0: counts}), 0.0, 30.0, 30)
    got = spectra.moments_around_maximum(hist, ["g"], cb=8).first()
    assert (got["peak_bin"], got["total"]) == (10, 14)
    assert got["mean"] == pytest.approx((3.5 * 5 + 10.5 * 9) / 14)
    errors = {r["bin"]: r["error"] for r in spectra.near_maximum(hist, ["g"]).collect()}
    assert errors == {3: pytest.approx(math.sqrt(5)), 10: 3.0}


def test_calibration(spark):
    rows = spark.createDataFrame([(10.0, 2.0), (10.0, 0.0)], "e double, mu double")
    assert [r[0] for r in rows.select(calibration.kev_from_peak("e", "mu")).collect()] == [2555.0, 0.0]
    assert rows.select(calibration.kev_from_polynomial("e", F.lit(2.0), F.lit(3.0), F.lit(4.0))).first()[0] == 234.0


def test_curves(spark):
    rows = spark.createDataFrame([(1.0,)], "x double")
    get = lambda c: rows.select(c).first()[0]
    assert get(curves.gaussian("x", 2, 1, 3)) == pytest.approx(2 / (3 * math.sqrt(2 * math.pi)))
    assert get(curves.gaussian("x", 2, 1, 0)) == math.inf
    assert get(curves.double_gaussian("x", 2, 1, 3, 2, 1, -1)) == math.inf
    assert get(curves.lorentzian("x", 5, 1, 2)) == 5 and get(curves.lorentzian("x", 5, 3, 2)) == 2.5


def test_slab_systems(spark):
    rows = spark.createDataFrame([(37,)], "slab int")
    system = slab_system.SYSTEMS["DEV-EB"]
    got = [
        rows.select(slab_system.slab_category("slab", system, g)).first()[0]
        for g in ("none", "sipm", "module", "position")
    ]
    assert got == [37, 18, 2, 5]
    assert rows.select(system.slab_position(F.lit(1))).first()[0] == pytest.approx(1.625 * 1.5)
    with pytest.raises(ValueError):
        _ = slab_system.SYSTEMS["ERC"].total_slabs
