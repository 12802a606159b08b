"""Peak model curves as column expressions, for writing fitted curves beside histograms."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str | float) -> Column:
    if isinstance(c, str):
        return F.col(c)
    return c if isinstance(c, Column) else F.lit(float(c))


def gaussian(x, amp, mu, sigma) -> Column:
    """Area-normalised Gaussian; infinite for a width that is not positive."""
    x, amp, mu, sigma = map(_col, (x, amp, mu, sigma))
    z = (x - mu) / F.when(sigma > 0, sigma)
    value = amp * F.exp(z * z * -0.5) / (sigma * math.sqrt(2 * math.pi))
    return F.when(sigma > 0, value).otherwise(F.lit(float("inf")))


def double_gaussian(x, amp1, mu1, sigma1, amp2, mu2, sigma2) -> Column:
    """Sum of two Gaussians; infinite if one width is not positive."""
    return gaussian(x, amp1, mu1, sigma1) + gaussian(x, amp2, mu2, sigma2)


def lorentzian(x, amp, mu, gamma) -> Column:
    """Lorentzian of half width ``gamma`` and maximum ``amp``; infinite for a width that is not positive."""
    x, amp, mu, gamma = map(_col, (x, amp, mu, gamma))
    value = amp * gamma * gamma / F.when(gamma > 0, (x - mu) * (x - mu) + gamma * gamma)
    return F.when(gamma > 0, value).otherwise(F.lit(float("inf")))
