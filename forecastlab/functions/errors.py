"""Error and share aggregates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rmse(y: Column | str, p: Column | str) -> Column:
    e = _c(y) - _c(p)
    return F.sqrt(F.avg(e * e))


def weighted_mean(x: Column | str, w: Column | str) -> Column:
    return F.try_divide(F.sum(_c(x) * _c(w)), F.sum(_c(w)))


def weighted_rmse(y: Column | str, p: Column | str, w: Column | str) -> Column:
    e = _c(y) - _c(p)
    return F.sqrt(F.try_divide(F.sum(_c(w) * e * e), F.sum(_c(w))))


def share(condition: Column) -> Column:
    """Part of the rows where a condition holds; rows where it is unknown do not count."""
    return F.avg(condition.cast("double"))


def coverage(y: Column | str, low: Column | str, high: Column | str, middle: Column | str) -> list[Column]:
    """Shares below, inside and above a band, and above the middle."""
    y, low, high, middle = _c(y), _c(low), _c(high), _c(middle)
    return [
        share(y < low).alias("under"),
        share(~(y < low) & ~(y > high)).alias("inside"),
        share(y > high).alias("over"),
        share(y > middle).alias("over_median"),
    ]
