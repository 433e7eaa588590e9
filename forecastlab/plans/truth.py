"""Evaluation set and the join of predictions to it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from forecastlab.functions.scalars import add_days, lead_hours

TRUTH_KEYS = ["bidding_area", "time_ref", "time", "lt"]


def evaluation_set(
    area_power: DataFrame, start: str | None = None, stop: str | None = None,
    issue_hour: int = 9, days: int = 2, value: str = "power",
) -> DataFrame:
    """Issue times at a fixed hour with every valid time of the day ``days`` later.

    The date condition is an equi-join key, so an issue time meets one day of its own series only.
    """
    issued = area_power.filter(F.hour("time") == issue_hour)
    if start is not None:
        issued = issued.filter(F.col("time") >= F.lit(start).cast("timestamp"))
    if stop is not None:
        issued = issued.filter(F.col("time") < F.lit(stop).cast("timestamp"))
    issued = issued.select(
        "bidding_area", F.col("time").alias("time_ref"), F.to_date(add_days("time", days)).alias("_day")
    )
    valid = area_power.select("bidding_area", "time", F.to_date("time").alias("_day"), F.col(value).alias("y_true"))
    return issued.join(valid, ["bidding_area", "_day"]).select(
        "bidding_area", "time_ref", "time", lead_hours("time", "time_ref").alias("lt"), "y_true"
    )


def with_prediction(
    truth: DataFrame, predictions: DataFrame, on: Sequence[str], fill: float | None = 0.0
) -> DataFrame:
    """Truth with ``y_pred``; a missing prediction counts as ``fill`` and is flagged in ``filled``."""
    joined = truth.join(predictions.select(*on, "y_pred"), list(on), "left")
    joined = joined.withColumn("filled", F.col("y_pred").isNull())
    return joined if fill is None else joined.fillna(fill, ["y_pred"])


def ensemble_mean_prediction(predictions: DataFrame, value: str = "local_power_pred") -> DataFrame:
    """Unit predictions added up per member, then averaged over members."""
    keys = ["time_ref", "time", "bidding_area"]
    per_member = predictions.groupBy(*keys, "em").agg(F.sum(value).alias("y_pred"))
    return per_member.groupBy(*keys).agg(F.avg("y_pred").alias("y_pred"))
