"""Small column functions: clipping, text numbers, times, guarded logarithms."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clip(x: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """Limit to a range; a missing value stays missing (``greatest`` alone would skip it)."""
    x = _c(x)
    limited = x
    if low is not None:
        limited = F.greatest(limited, F.lit(float(low)))
    if high is not None:
        limited = F.least(limited, F.lit(float(high)))
    return F.when(x.isNotNull(), limited)


def round_to(name: str, digits: int) -> Column:
    """``round`` of a double column, value for value, without writing most numbers out as text.

    Spark rounds a double through its shortest decimal text. Where the scaled number is neither huge nor near the middle of two results, the
    nearest whole number gives the same result; only the others take the way through text. The column is named several times here, so it
    should be a finished column and not an expression.
    """
    scaled = F.col(name) * float(10**digits)
    nearest = F.rint(scaled)
    plain = (F.abs(scaled) < 1e9) & (F.abs(F.abs(scaled - nearest) - 0.5) > 1e-5)
    return F.when(plain, nearest / float(10**digits) + 0.0).otherwise(F.round(name, digits))


def decimal_comma(x: Column | str) -> Column:
    """Number written with a decimal comma; unreadable text becomes null."""
    return F.replace(_c(x), F.lit(","), F.lit(".")).try_cast("double")


def last_chars(x: Column | str, n: int) -> Column:
    return F.right(_c(x), F.lit(n))


def offset_to_utc(x: Column | str, hours: int) -> Column:
    """Local text time at a fixed offset (no daylight saving) to UTC."""
    return F.timestamp_add("HOUR", F.lit(-hours), F.try_to_timestamp(_c(x), F.lit("yyyy-MM-dd HH:mm:ss")))


def lead_hours(time: Column | str, time_ref: Column | str) -> Column:
    """Whole hours from issue to valid time, truncated toward zero."""
    micros = F.unix_micros(_c(time)) - F.unix_micros(_c(time_ref))
    return (micros / 3_600_000_000).cast("long")


def add_hours(time: Column | str, hours: Column | str | int) -> Column:
    hours = F.lit(hours) if isinstance(hours, int) else _c(hours)
    return F.timestamp_add("HOUR", hours.cast("int"), _c(time))


def add_days(time: Column | str, days: int) -> Column:
    return F.timestamp_add("DAY", F.lit(days), _c(time))


def is_day_ahead(time: Column | str, time_ref: Column | str, days: int = 2) -> Column:
    """Valid date is the issue date plus ``days``."""
    return F.to_date(_c(time)) == F.to_date(add_days(time_ref, days))


def guarded_log(x: Column | str, floor: float = 1e-6) -> Column:
    """Logarithm that stays finite when a spread or ramp is zero."""
    return F.ln(clip(x, low=floor))


def ratio(a: Column | str, b: Column | str) -> Column:
    """Quotient; null where the divisor is zero."""
    return F.try_divide(_c(a), _c(b))


def logit(x: Column | str, eps: float = 1e-4) -> Column:
    p = clip(x, eps, 1 - eps)
    return F.ln(p / (1 - p))


def inverse_logit(x: Column | str) -> Column:
    return 1 / (1 + F.exp(-_c(x)))
