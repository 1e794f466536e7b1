"""Null-safe arithmetic, time and flag expressions.

Everything here is a plain Column expression, so it stays inside whole-stage
code generation. Missing input gives a missing result unless a function says
otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MICROS_PER_SECOND = 1e6
SECONDS_PER_DAY = 86400.0

# Weekday names in calendar order.
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
WEEKEND = ["saturday", "sunday"]


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def holds(condition: Column) -> Column:
    """A condition read with "unknown means no", so that ``~holds(...)`` keeps nulls."""
    return F.coalesce(condition, F.lit(False))


def safe_divide(numerator: str | Column, denominator: str | Column) -> Column:
    """Quotient, or NULL for a zero denominator (plain division raises in ANSI mode)."""
    return F.try_divide(col(numerator).cast("double"), col(denominator).cast("double"))


def finite_or_null(c: str | Column) -> Column:
    c = col(c)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def round_half_even(c: str | Column, digits: int = 0) -> Column:
    """Round to even on ties; adding 0.0 turns a negative zero into zero."""
    scale = float(10 ** digits)
    return F.rint(col(c) * scale) / scale + F.lit(0.0)


def truncate(c: str | Column) -> Column:
    """Whole part toward zero as an integer."""
    return col(c).cast("int")


def clip(c: str | Column, low: float, high: float) -> Column:
    c = col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def elapsed_days(later: str | Column, earlier: str | Column) -> Column:
    micros = F.unix_micros(col(later)) - F.unix_micros(col(earlier))
    return micros / MICROS_PER_SECOND / SECONDS_PER_DAY


def weekday_name(ts: str | Column) -> Column:
    return F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.weekday(col(ts)) + 1)


def weekday_order(name: str | Column) -> Column:
    """1 for monday ... 7 for sunday; gives reports their calendar order."""
    return F.array_position(F.array(*map(F.lit, WEEKDAYS)), col(name)).cast("int")


def is_weekend(name: str | Column) -> Column:
    return col(name).isin(*WEEKEND).cast("int")


def equals_flag(c: str | Column, value) -> Column:
    """1 when equal, 0 otherwise, also for a missing value."""
    return holds(col(c) == F.lit(value)).cast("int")


def differs_flag(a: str | Column, b: str | Column) -> Column:
    """1 when the two differ; a missing side counts as different."""
    return F.coalesce((col(a) != col(b)).cast("int"), F.lit(1))


def relabel(c: str | Column, mapping: dict, keep_unknown: bool = True) -> Column:
    """Replace whole values by a small literal mapping."""
    c = col(c)
    out = None
    for key, label in mapping.items():
        out = F.when(c == key, F.lit(label)) if out is None else out.when(c == key, F.lit(label))
    return out.otherwise(c) if keep_unknown else out


def count_label(name: str | Column, n: str | Column, unit: str = "건") -> Column:
    return F.concat(col(name), F.lit(" ("), col(n).cast("string"), F.lit(f"{unit})"))


def haversine_km(lat1, lng1, lat2, lng2, radius_km: float = 6371.0) -> Column:
    """Great-circle distance between two points given in degrees."""
    phi1, phi2 = F.radians(col(lat1)), F.radians(col(lat2))
    half_dphi = (phi2 - phi1) / 2.0
    half_dlambda = (F.radians(col(lng2)) - F.radians(col(lng1))) / 2.0
    chord = (F.sin(half_dphi) * F.sin(half_dphi)
             + F.cos(phi1) * F.cos(phi2) * F.sin(half_dlambda) * F.sin(half_dlambda))
    return F.asin(F.sqrt(chord)) * (2.0 * radius_km)
