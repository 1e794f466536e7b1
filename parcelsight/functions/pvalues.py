"""Tail probabilities for the last, scalar step of a test.

Spark has done all the counting by then; these take a handful of numbers.
Normal, chi-square (any df) and Student t tails, standard library only.
"""

from __future__ import annotations

import math


def normal_sf(z: float) -> float:
    """P(Z > z)."""
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def normal_ppf(p: float) -> float:
    """Quantile of the standard normal by bisection on the tail function."""
    low, high = -40.0, 40.0
    for _ in range(200):
        mid = (low + high) / 2.0
        if 1.0 - normal_sf(mid) < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2.0


def chi2_sf(x: float, df: int) -> float:
    """P(X > x) through the recurrence Q(a+1) = Q(a) + x^a e^-x / Gamma(a+1)."""
    if x <= 0:
        return 1.0
    half = x / 2.0
    if df % 2 == 0:
        q, a = math.exp(-half), 1.0
    else:
        q, a = math.erfc(math.sqrt(half)), 0.5
    while a < df / 2.0:
        q += math.exp(a * math.log(half) - half - math.lgamma(a + 1.0))
        a += 1.0
    return min(q, 1.0)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 500):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + numerator / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return value


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def student_two_sided(t: float, df: float) -> float:
    """P(|T| > |t|)."""
    if math.isinf(t):
        return 0.0
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))
