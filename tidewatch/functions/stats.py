"""Column expressions for rates, intervals and bins. An undefined value is NULL, never NaN."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CONFIDENCE


def z_score(confidence: float) -> float:
    if not 0 < confidence < 1:
        raise ValueError("confidence must lie between 0 and 1")
    return NormalDist().inv_cdf(0.5 + confidence / 2)


def wilson(successes: int, n: int, confidence: float = CONFIDENCE) -> tuple[float, float, float]:
    """(estimate, lower, upper) of a proportion by Wilson's score interval."""
    if n <= 0 or not 0 <= successes <= n:
        raise ValueError("a proportion needs 0 <= successes <= n and n > 0")
    z, p = z_score(confidence), successes / n
    middle, half = p + z * z / (2 * n), z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return p, max(0.0, (middle - half) / (1 + z * z / n)), min(1.0, (middle + half) / (1 + z * z / n))


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def wilson_bounds(successes: Column, n: Column, confidence: float = CONFIDENCE) -> tuple[Column, Column]:
    """Lower and upper bound columns; NULL where n is 0."""
    z = z_score(confidence)
    k, m = successes.cast("double"), F.nullif(n.cast("double"), F.lit(0.0))
    p, zz = k / m, F.lit(z * z)
    half = F.lit(z) * F.sqrt(p * (1 - p) / m + zz / (4 * m * m))
    middle, scale = p + zz / (2 * m), 1 + zz / m
    lower, upper = (middle - half) / scale, (middle + half) / scale
    return F.when(m.isNotNull(), F.greatest(lower, F.lit(0.0))), F.when(m.isNotNull(), F.least(upper, F.lit(1.0)))


def clip(x: Column, low: float, high: float) -> Column:
    """x held to [low, high]; NULL stays NULL."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def linspace(bins: int) -> list[float]:
    """bins + 1 edges from 0 to 1, with the rounding of i * (1 / bins)."""
    return [*(i * (1.0 / bins) for i in range(bins)), 1.0]


def left_closed_bin(x: Column, bins: int) -> Column:
    """Index of [edge, next edge); the last bin also holds 1; NULL outside [0, 1]."""
    edges = linspace(bins)
    index = sum((F.when(x >= e, 1).otherwise(0) for e in edges[1:-1]), F.lit(0))
    return F.when(x.between(0.0, 1.0), index)


def right_closed_bin(x: Column, bins: int) -> Column:
    """Index of (edge, next edge]; the first bin also holds 0; values outside go to the end bins."""
    edges = linspace(bins)
    index = sum((F.when(x > e, 1).otherwise(0) for e in edges[1:-1]), F.lit(0))
    return F.when(x.isNotNull(), index)


def chi2_p_value(statistic: float) -> float:
    """Upper tail of chi-square with one degree of freedom."""
    return math.erfc(math.sqrt(statistic / 2))


#: Two samples of at most this size have an exact Kolmogorov-Smirnov p-value.
EXACT_ROWS = 10_000


def kolmogorov_p_value(distance: float, n: int, m: int) -> float:
    """Two-sample Kolmogorov-Smirnov p-value: exact up to EXACT_ROWS a side, from the limiting distribution beyond."""
    if distance <= 0:
        return 1.0
    if max(n, m) <= EXACT_ROWS:
        inside = _share_inside(distance, n, m)
        if inside < 1 - 1e-9:  # closer to 1 the difference is lost to rounding
            return max(0.0, 1 - inside)
    x = math.sqrt(n * m / (n + m)) * distance
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def _share_inside(distance: float, n: int, m: int) -> float:
    """Share of the orders of n and m values in which the two distribution functions never differ by ``distance`` or more.

    An order is a lattice path. After s values, kept[k] is the chance that a path to k values of the first
    sample has stayed inside; the last value was one of the first sample's with chance k / s.
    """
    limit = (round(distance * n * m) - 0.5) / (n * m)  # distances are multiples of 1 / (n * m)
    kept = np.zeros(n + 2)  # kept[k + 1], with a zero before the first
    kept[1] = 1.0
    pace = 1 / n + 1 / m
    for s in range(1, n + m + 1):
        low = max(0, s - m, math.ceil((s / m - limit) / pace - 1e-9))
        high = min(n, s, math.floor((s / m + limit) / pace + 1e-9))
        k = np.arange(low, high + 1)
        after = (kept[low : high + 1] * k + kept[low + 1 : high + 2] * (s - k)) / s
        kept[max(low - 1, 0) : high + 2] = 0.0
        kept[low + 1 : high + 2] = after
    return float(kept[n + 1])


def two_sided_p_value(z: float) -> float:
    return 2 * (1 - NormalDist().cdf(abs(z)))
