"""Tail probabilities used on the driver for a handful of test statistics."""

from __future__ import annotations

import math
from statistics import NormalDist


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def two_sided_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def chi2_sf(x: float, df: int) -> float:
    """Upper tail of the chi-squared distribution with whole degrees of freedom.

    The survival function obeys Q(df + 2) = Q(df) + (x/2)^(df/2) e^(-x/2) / Gamma(df/2 + 1),
    with closed forms for one and two degrees of freedom.
    """
    if x <= 0.0:
        return 1.0
    half = x / 2.0
    if df % 2:
        tail, step = math.erfc(math.sqrt(half)), 1
    else:
        tail, step = math.exp(-half), 2
    while step < df:
        tail += math.exp(step / 2.0 * math.log(half) - half - math.lgamma(step / 2.0 + 1.0))
        step += 2
    return min(tail, 1.0)
