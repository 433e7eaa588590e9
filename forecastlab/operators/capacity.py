"""Active capacity: what the units of an area that had started by a given time add up to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from forecastlab.operators.series import month_of, running_totals
from forecastlab.session import settle

CAPACITY = ("operating_power_max", "mean_production", "num_turbines")


def active_capacity(
    asked: DataFrame, units: DataFrame, time: str = "time", area: str = "bidding_area",
    start: str = "production_start_date", values: Sequence[str] = CAPACITY,
) -> DataFrame:
    """Capacity per distinct ``(area, time)`` of ``asked``; areas with no started unit are absent.

    Units are first added up by start date, so the running sum sees steps and not units. Asked times
    are sorted in between the steps: no unit meets every time. Steps and asked times are settled, so
    that ``asked`` is computed once for the two levels of the running sum.
    """
    steps = (
        units.groupBy(area, F.col(start).alias("_at"))
        .agg(*[F.sum(v).alias(v) for v in values], F.count(F.lit(1)).alias("_units"))
        .withColumn("_ask", F.lit(0))
    )
    points = asked.select(area, F.col(time).alias("_at")).distinct().withColumn("_ask", F.lit(1))
    merged = settle(steps.unionByName(points, allowMissingColumns=True), "steps")
    summed = running_totals(merged, [area], ["_at", "_ask"], [*values, "_units"], month_of("_at"))
    return summed.filter((F.col("_ask") == 1) & (F.col("cum__units") > 0)).select(
        area, F.col("_at").alias(time), *[F.col(f"cum_{v}").alias(v) for v in values]
    )
