"""Gaussian fits of histograms.

The histogram of a group is one row with an array of its bins, whatever number of events lies behind it, and is fitted by column
expressions (``functions.fitting``). ``fit_histogram``, ``least_squares`` and ``rightmost_peak`` do the same for one histogram at hand, on the driver.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitframe.functions import fitting
from hitframe.operators.spectra import SPECTRUM_BINS, histogram

# Default fit settings and the default half width of the photopeak window, relative to the mean.
HALF_RANGE, MIN_PEAK, PEAK_SHARE = 8, 50, 0.2


def _bells(x: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of area-normalised Gaussians (three parameters each) and its derivatives."""
    value, slopes = np.zeros_like(x), []
    for area, mean, sigma in p.reshape(-1, 3):
        z = (x - mean) / sigma
        unit = np.exp(-0.5 * z * z) / (np.sqrt(2 * np.pi) * sigma)
        value = value + area * unit
        slopes += [unit, area * unit * z / sigma, area * unit * (z * z - 1) / sigma]
    return value, np.stack(slopes, axis=1)


def least_squares(x: np.ndarray, y: np.ndarray, err: np.ndarray, start: np.ndarray, steps: int = 500):
    """Damped Gauss-Newton on the weighted residuals; parameters and their covariance scaled by chi2 per dof.

    Returns None if no minimum is found. Widths must stay positive.
    """
    p, damping = start.astype(float), 1e-3
    value, slopes = _bells(x, p)
    r = (y - value) / err
    cost = r @ r
    for _ in range(steps):
        j = slopes / err[:, None]
        normal, gradient = j.T @ j, j.T @ r
        scale = np.diag(normal).copy()
        scale[scale == 0] = 1.0
        step = np.linalg.lstsq(normal + damping * np.diag(scale), gradient, rcond=None)[0]
        trial = p + step
        if (trial[2::3] > 0).all():
            trial_value, trial_slopes = _bells(x, trial)
            trial_r = (y - trial_value) / err
            trial_cost = trial_r @ trial_r
        else:
            trial_cost = np.inf
        if np.isfinite(trial_cost) and trial_cost <= cost:
            gain = cost - trial_cost
            p, r, cost, slopes = trial, trial_r, trial_cost, trial_slopes
            damping = max(damping / 10, 1e-12)
            if gain <= 1e-12 * max(cost, 1e-300) and np.all(np.abs(step) <= 1e-9 * (np.abs(p) + 1e-9)):
                break
        else:
            damping *= 10
            if damping > 1e12:
                break
    j = slopes / err[:, None]
    freedom = len(x) - len(p)
    if not np.isfinite(cost) or freedom <= 0:
        return None
    covariance = np.linalg.pinv(j.T @ j) * (cost / freedom)
    return p, covariance


def rightmost_peak(y: np.ndarray, height: float, distance: int, prominence: float, width: float) -> int | None:
    """Position of the last peak that is high, isolated, prominent and wide enough, or None.

    A plateau counts once, at its middle. Of peaks closer than ``distance`` the higher one stays. Width is measured at
    half prominence.
    """
    n = len(y)
    rises = np.flatnonzero(np.diff(y) != 0)
    starts = np.concatenate([[0], rises + 1])
    ends = np.concatenate([rises, [n - 1]])
    level = y[starts]
    inner = np.arange(1, len(starts) - 1)
    top = inner[(level[inner] > level[inner - 1]) & (level[inner] > level[inner + 1])]
    peaks = (starts[top] + ends[top]) // 2
    peaks = peaks[y[peaks] >= height]

    kept: list[int] = []
    for k in sorted(peaks, key=lambda i: (y[i], i), reverse=True):
        if all(abs(k - other) >= distance for other in kept):
            kept.append(int(k))

    for k in sorted(kept, reverse=True):
        higher = np.flatnonzero(y > y[k])
        left = higher[higher < k].max() + 1 if (higher < k).any() else 0
        right = higher[higher > k].min() - 1 if (higher > k).any() else n - 1
        rise = y[k] - max(y[left : k + 1].min(), y[k : right + 1].min())
        if rise >= prominence and _width_at(y, k, y[k] - rise / 2, left, right) >= width:
            return k
    return None


def _width_at(y: np.ndarray, k: int, level: float, left: int, right: int) -> float:
    """Distance between the two points around ``k`` where ``y`` crosses ``level``, linearly interpolated."""
    below = np.flatnonzero(y[left:k] <= level)
    a = float(left)
    if len(below):
        i = left + below[-1]
        a = i + (level - y[i]) / (y[i + 1] - y[i]) if y[i] < level else float(i)
    below = np.flatnonzero(y[k + 1 : right + 1] <= level)
    b = float(right)
    if len(below):
        i = k + 1 + below[0]
        b = i - (level - y[i]) / (y[i - 1] - y[i]) if y[i] < level else float(i)
    return b - a


def fit_histogram(
    counts: np.ndarray,
    centres: np.ndarray,
    cb: int = HALF_RANGE,
    min_peak: int = MIN_PEAK,
    finder: str = "max",
    model: str = "gaussian",
    x_shift: float = 0.0,
) -> dict:
    """Fit around the maximum (``max``) or around the rightmost good peak (``peak``) of one dense histogram."""
    empty = dict(params=None, covariance=None, chi2_ndf=None, curve=None)
    if len(counts) == 0 or counts.max() < min_peak:
        return {**empty, "problem": "maximum below the required height"}
    peak = None
    if finder == "peak":
        peak = rightmost_peak(counts, counts.max() / 2, cb, min_peak // 2, cb // 2)
    middle = int(counts.argmax()) if peak is None else peak
    part = slice(max(middle - cb, 0), min(middle + cb, len(counts)))
    x, y = centres[part] + (x_shift if peak is None else 0.0), counts[part]
    total = y.sum()
    mean = centres[peak] if peak is not None else (x * y).sum() / total
    spread = ((x - mean) ** 2 * y).sum() / total
    if total > 1:
        spread *= total / (total - 1)
    used = y > 0
    start = np.array([total, mean, np.sqrt(spread)] * (2 if model == "double" else 1))
    if not spread > 0:
        return {**empty, "problem": "no width to fit"}
    found = least_squares(x[used], y[used], np.sqrt(y[used]), start)
    if found is None:
        return {**empty, "problem": "no fit found"}
    params, covariance = found
    residual = (y[used] - _bells(x[used], params)[0]) / np.sqrt(y[used])
    freedom = used.sum() - 3
    return dict(
        params=params.tolist(),
        covariance=covariance.tolist(),
        chi2_ndf=float(residual @ residual / freedom) if freedom > 0 else None,
        curve=_bells(centres, params)[0].tolist(),
        problem=None,
    )


@lru_cache(maxsize=8)
def _fit_column(count: int, jvm) -> Column:
    """The fit of ``__points`` from ``__start``; making it takes about a second, so it is kept for other tables of the same JVM."""
    return fitting.least_squares(F.col("__points"), F.col("__start"), count)


def dense(hist: DataFrame, by: list[str], bins: int) -> DataFrame:
    """One row per group: ``counts``, an array of double with every bin of a histogram (columns ``by``, ``bin``, ``count``)."""
    found = hist.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("bin", F.col("count").cast("double")))).alias("m"))
    zero = F.lit(0.0)
    return found.select(*by, F.transform(fitting.indices(bins), lambda i: F.coalesce(F.try_element_at("m", i), zero)).alias("counts"))


def fit_peaks(
    hist: DataFrame,
    by: list[str],
    bins: int,
    limits: tuple[float, float],
    cb: int = HALF_RANGE,
    min_peak: int = MIN_PEAK,
    finder: str = "max",
    model: str = "gaussian",
    legacy_half_bin: bool = False,
) -> DataFrame:
    """One fit per group of a histogram (columns ``by``, ``bin``, ``count``), around the maximum (``finder="max"``) or around the rightmost
    good peak (``"peak"``; the maximum if there is none).

    Columns: ``params`` (area, mean, sigma, twice for ``model="double"``), ``covariance``, ``chi2_ndf``, the ``curve``
    at all bin centres, and ``problem`` (NULL on success; a group that cannot be fitted is reported, not dropped). A double fit starts from the
    moments of the points on both sides of the mean. ``legacy_half_bin`` evaluates the maximum finder half a bin too high, as older results did.

    A group's histogram is one row with an array of all bins, and everything after that happens in columns.
    """
    width, count = (limits[1] - limits[0]) / bins, 2 if model == "double" else 1
    shift = width / 2 if legacy_half_bin else 0.0
    counts = F.col("counts")
    centre = lambda i: limits[0] + (i + 0.5) * width
    get = lambda c, i: F.get(c, F.lit(i))

    rows = dense(hist, by, bins).withColumn("__top", F.array_max(counts))
    peak = F.lit(None).cast("int")
    if finder == "peak":
        peak = fitting.rightmost_peak(counts, F.col("__top") / 2, cb, min_peak // 2, cb // 2)
    rows = rows.withColumn("__peak", F.when(F.col("__top") >= min_peak, peak))
    middle = F.coalesce("__peak", (F.array_position(counts, F.col("__top")) - 1).cast("int"))
    rows = rows.withColumn("__middle", middle)
    part = F.sequence(F.greatest(F.col("__middle") - cb, F.lit(0)), F.least(F.col("__middle") + cb, F.lit(bins)) - 1)
    x = lambda i: centre(i) + F.when(F.col("__peak").isNull(), F.lit(shift)).otherwise(F.lit(0.0))
    point = lambda i: F.struct(x(i).alias("x"), F.get(counts, i).alias("y"), F.sqrt(F.get(counts, i)).alias("err"))
    rows = rows.withColumn("__points", F.filter(F.transform(part, point), lambda q: q["y"] > 0))
    points = F.col("__points")

    whole = fitting.moments(points)
    rows = rows.withColumn("__m", whole)
    mean = F.coalesce(centre(F.col("__peak")), F.col("__m.mean"))
    rows = rows.withColumn("__mean", mean).withColumn("__spread", fitting.spread(points, F.col("__m.total"), F.col("__mean")))
    start = F.array("__m.total", "__mean", F.sqrt("__spread"))
    if count == 2:
        left, right = (fitting.moments(F.filter(points, side)) for side in (lambda q: q["x"] < F.col("__mean"), lambda q: q["x"] >= F.col("__mean")))
        rows = rows.withColumn("__left", left).withColumn("__right", right)
        half = lambda c: (
            F.col(f"{c}.total"), F.coalesce(F.col(f"{c}.mean"), F.col("__mean")),
            F.when(F.col(f"{c}.spread") > 0, F.sqrt(f"{c}.spread")).otherwise(F.sqrt("__spread") / 2),
        )
        start = F.array(*half("__left"), *half("__right"))
    problem = F.when(F.col("__top") < min_peak, "maximum below the required height").when(~F.coalesce(F.col("__spread") > 0, F.lit(False)), "no width to fit")
    rows = rows.withColumn("__problem", problem)
    rows = rows.withColumn("__start", start)
    rows = rows.withColumn("__fit", F.when(F.col("__problem").isNull(), _fit_column(count, SparkContext._jvm)))
    freedom = F.size(points) - 3
    good = F.col("__fit.found")
    return rows.select(
        *by,
        F.when(good, F.col("__fit.p")).alias("params"),
        F.when(good, F.col("__fit.covariance")).alias("covariance"),
        F.when(good & (freedom > 0), F.try_divide(F.col("__fit.cost"), freedom)).alias("chi2_ndf"),
        F.when(good, F.transform(fitting.indices(bins), lambda i: fitting.curve(centre(i), F.col("__fit.p"), count))).alias("curve"),
        F.coalesce(F.col("__problem"), F.when(~F.coalesce(good, F.lit(False)), "no fit found")).alias("problem"),
    )


def photopeak_window(
    events: DataFrame,
    energy: str = "energy1",
    share: float = PEAK_SHARE,
    bins: int = SPECTRUM_BINS,
    limits: tuple[float, float] = (0.0, 200.0),
    min_peak: int = MIN_PEAK,
) -> DataFrame:
    """One row: fitted photopeak mean and the window around it, from the spectrum of ``energy``."""
    hist = histogram(events, energy, bins, limits).withColumn("spectrum", F.lit(0))
    fitted = fit_peaks(hist, ["spectrum"], bins, limits, min_peak=min_peak)
    mu = F.col("params")[1]
    return fitted.select(
        mu.alias("mu"),
        F.col("params")[2].alias("sigma"),
        (mu * (1 - share)).alias("peak_low"),
        (mu * (1 + share)).alias("peak_high"),
        "problem",
    )


def in_photopeak(window: DataFrame, energy: Column | str = "energy1") -> Column:
    """Condition on ``energy`` using the one-row window as one scalar subquery, so no join is involved."""
    e = F.col(energy) if isinstance(energy, str) else energy
    # a window without a fit would let nothing pass, which looks like a result
    problem = F.coalesce("problem", F.lit("no fit")) if "problem" in window.columns else F.lit("no fit")
    failed = F.raise_error(F.concat(F.lit("no photopeak window: "), problem)).cast("double")
    low, high = (F.coalesce(F.col(c), failed).alias(c) for c in ("peak_low", "peak_high"))
    limits = window.select(F.struct(low, high).alias("limits")).scalar()
    return (e > limits["peak_low"]) & (e < limits["peak_high"])
