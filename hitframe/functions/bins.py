"""Uniform histogram bins, numbered from 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bin_width(low: float, high: float, n: int) -> float:
    return (high - low) / n


def bin_index(value: Column | str, low: float, high: float, n: int) -> Column:
    """Half-open bins, the last one closed; NULL outside the range.

    A value is first placed by scaling and then corrected against the edges ``low + k * width``, so values that equal
    an edge always land in the bin that starts there.
    """
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    width = F.lit(bin_width(low, high, n))
    raw = F.least(F.floor((v - F.lit(float(low))) * F.lit(float(n)) / F.lit(float(high - low))), F.lit(n - 1))
    too_high = (v < F.lit(float(low)) + raw * width).cast("bigint")
    too_low = ((v >= F.lit(float(low)) + (raw + 1) * width) & (raw != n - 1)).cast("bigint")
    return F.when(v.between(float(low), float(high)), raw - too_high + too_low).cast("int")


def bin_low(index: Column | str, low: float, high: float, n: int) -> Column:
    b = F.col(index) if isinstance(index, str) else index
    return F.lit(float(low)) + b * F.lit(bin_width(low, high, n))


def bin_high(index: Column | str, low: float, high: float, n: int) -> Column:
    b = F.col(index) if isinstance(index, str) else index
    return F.when(b == n - 1, F.lit(float(high))).otherwise(bin_low(b + 1, low, high, n))


def centre(low_edge: Column | str, high_edge: Column | str) -> Column:
    """Middle of a bin."""
    lo = F.col(low_edge) if isinstance(low_edge, str) else low_edge
    hi = F.col(high_edge) if isinstance(high_edge, str) else high_edge
    return lo + (hi - lo) * 0.5
