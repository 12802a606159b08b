"""Energy calibration to keV."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: photon energy in keV that the photopeak position mu corresponds to.
PHOTOPEAK_KEV = 511.0


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def kev_from_peak(energy: Column | str, mu: Column | str) -> Column:
    """Scale by the photopeak position; 0 where the position is 0."""
    return F.when(_col(mu) != 0, F.lit(PHOTOPEAK_KEV) / _col(mu) * _col(energy)).otherwise(F.lit(0.0))


def kev_from_polynomial(energy: Column | str, c0: Column | str, c1: Column | str, c2: Column | str) -> Column:
    """Second-degree polynomial, highest power first."""
    e = _col(energy)
    return _col(c0) * e * e + _col(c1) * e + _col(c2)
