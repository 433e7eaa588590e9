"""Statistics over the members of one row, kept in the JVM as array expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def members(columns: Sequence[str]) -> Column:
    """Present members as an array; the array is as long as the ensemble, never as the data."""
    return F.array_compact(F.array(*[F.col(f"`{c}`") for c in columns]))


def array_mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    return F.try_divide(total, F.size(values))


def array_std(values: Column) -> Column:
    """Sample standard deviation, null below two members.

    One pass over distances from the first member, which avoids the cancellation of raw squares.
    """
    n, origin = F.size(values), F.get(values, F.lit(0))
    sums = F.aggregate(
        values,
        F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("ss")),
        lambda acc, x: F.struct(
            (acc["s"] + (x - origin)).alias("s"), (acc["ss"] + (x - origin) * (x - origin)).alias("ss")
        ),
        lambda acc: F.sqrt(F.greatest(acc["ss"] - acc["s"] * acc["s"] / n, F.lit(0.0)) / (n - 1)),
    )
    return F.when(n > 1, sums)


def array_median(values: Column) -> Column:
    ordered, n = F.array_sort(values), F.size(values)
    low = F.get(ordered, F.floor((n - 1) / 2).cast("int"))
    high = F.get(ordered, F.floor(n / 2).cast("int"))
    return (low + high) / 2


def array_quantile(ordered: Column, q: float) -> Column:
    """Linear interpolation between the two neighbouring order statistics of a sorted array."""
    h = (F.size(ordered) - 1) * F.lit(q)
    low = F.floor(h)
    below = F.get(ordered, low.cast("int"))
    above = F.get(ordered, F.ceil(h).cast("int"))
    return below + (above - below) * (h - low)


def array_crps(y: Column, draws: Column) -> Column:
    """Mean absolute error less half the mean spread of the draws.

    The spread is a sum over ranks of the sorted array. One draw leaves the absolute error.
    """
    n = F.size(draws)
    error = F.aggregate(draws, F.lit(0.0), lambda acc, x: acc + F.abs(x - y)) / n
    ranked = F.transform(F.array_sort(draws), lambda x, i: x * (2 * i + 1 - n))
    spread = F.aggregate(ranked, F.lit(0.0), lambda acc, x: acc + x) / (n * n)
    return error - spread
