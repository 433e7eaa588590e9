"""Area data set: one row per ``(time_ref, time, area)`` with 18 features."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from forecastlab.functions import ensemble
from forecastlab.functions.scalars import last_chars, ratio
from forecastlab.operators.capacity import active_capacity
from forecastlab.operators.intervals import visible_totals
from forecastlab.operators.series import rolling, series_columns
from forecastlab.session import settle

# The feature lists of the area models.
AREA_FEATURES = [
    "last_power", "recent_mean", "ramp", "recent_max", "recent_min", "recent_range", "recent_std", "lt",
    "unplannedEvent", "unavailable_transmission",
]
EMOS_FEATURES = [
    "mean_sum_pred", "std_sum_pred", "min_sum_pred", "max_sum_pred", "pred_lag1", "pred_lag2",
    "pred_lead1", "pred_lead2",
]
KEYS = [
    "time_ref", "time", "bidding_area", "power", "relative_power", "operating_power_max",
    "mean_production", "num_turbines",
]
ISSUE = ["time_ref", "time", "lt", "bidding_area"]
RECENT_ROWS = 24


def relative_power(area_power: DataFrame, units: DataFrame) -> DataFrame:
    """Area production with the capacity active at that time and their quotient."""
    capacity = active_capacity(area_power, units)
    return area_power.join(capacity, ["bidding_area", "time"]).withColumn(
        "relative_power", ratio("power", "operating_power_max")
    )


def recent_columns(value: str, window: WindowSpec, rows: int = RECENT_ROWS, compat: bool = False) -> dict[str, Column]:
    """Last value, trailing statistics and ramp over one window specification."""
    top, low = rolling(F.max, value, rows, window), rolling(F.min, value, rows, window)
    return {
        "last_power": F.col(value),
        "recent_mean": rolling(F.avg, value, rows, window),
        "recent_max": top,
        "recent_min": low,
        "recent_range": top - low,
        "recent_std": low if compat else rolling(F.stddev_samp, value, rows, window),
        "ramp": F.col(value) - F.lag(value).over(window),
    }


def recent_block(relative: DataFrame, compat: bool = False) -> DataFrame:
    """Recent production of each area at each time, as known then.

    ``compat`` gives ``recent_std`` as the rolling minimum, which is what earlier models were
    trained on; otherwise it is the sample standard deviation.
    """
    return series_columns(
        relative, ["bidding_area"], "time",
        lambda w: recent_columns("relative_power", w, compat=compat), before=RECENT_ROWS - 1,
    )


def member_sums(predictions: DataFrame, value: str = "local_power_pred") -> DataFrame:
    """Unit predictions added up per issue time, valid time, area and member."""
    return predictions.groupBy(*ISSUE, "em").agg(F.sum(value).alias("sum_local_pred"))


def ensemble_sums(predictions: DataFrame, value: str = "local_power_pred") -> DataFrame:
    """Area sums of all members that occur, as one array per issue and valid time in the order of the members.

    Units are added up per member first, with partial sums before the shuffle; the array is as long as the ensemble. ``predictions`` has a row per member
    or, without ``em``, the members side by side as ``<value>_<em>``: then a unit's row is looked up once and not once per member.
    """
    if "em" not in predictions.columns:
        members = sorted((c for c in predictions.columns if re.fullmatch(rf"{re.escape(value)}_\d+", c)), key=lambda c: int(c.rsplit("_", 1)[1]))
        sums = predictions.groupBy(*ISSUE).agg(*[F.sum(c).alias(c) for c in members])
        return sums.select(*ISSUE, F.array_compact(F.array(*members)).alias("member_sums"))
    sums = member_sums(predictions, value).groupBy(*ISSUE).agg(
        F.array_sort(F.collect_list(F.when(F.col("sum_local_pred").isNotNull(), F.struct("em", "sum_local_pred")))).alias("_m")
    )
    return sums.select(*ISSUE, F.transform("_m", lambda m: m["sum_local_pred"]).alias("member_sums"))


def neighbours(df: DataFrame, value: str = "mean_sum_pred") -> DataFrame:
    """Lag and lead of the mean prediction inside one issue time; a group is one set of lead times."""
    window = Window.partitionBy("time_ref", "bidding_area").orderBy("time")
    return df.withColumns(
        {
            **{f"pred_lag{k}": F.lag(value, k).over(window) for k in (1, 2)},
            **{f"pred_lead{k}": F.lead(value, k).over(window) for k in (1, 2)},
        }
    )


def with_transmission(df: DataFrame, transmission: DataFrame) -> DataFrame:
    """Share of transmission into the area reported unavailable, and whether any part is unplanned."""
    rows = df.select("time_ref", "time", last_chars("bidding_area", 3).alias("outAreaName"))
    known = visible_totals(
        rows, transmission, ["outAreaName"], ["unavailableCapacity", "installedCapacity"], ["unplannedEvent"]
    )
    share = known.select(
        F.col("outAreaName").alias("_area"), "time_ref", "time", "unplannedEvent",
        ratio("unavailableCapacity", "installedCapacity").alias("unavailable_transmission"),
    )
    joined = df.withColumn("_area", last_chars("bidding_area", 3)).join(share, ["_area", "time_ref", "time"], "left")
    return joined.drop("_area").fillna({"unplannedEvent": False, "unavailable_transmission": 0.0})


def area_dataset(
    predictions: DataFrame, area_power: DataFrame, units: DataFrame, transmission: DataFrame, compat: bool = False
) -> DataFrame:
    """The whole area table, unsorted.

    Predictions are scaled by the capacity at issue time, the target by the capacity at valid time.
    The capacity at issue time comes with the recent block, so capacity is computed once. Three small
    tables (area by time, area by issue and valid time) are settled because several branches read
    them; predictions and production, the large inputs, are read once.
    """
    relative = settle(relative_power(settle(area_power, "area_power"), units), "relative")
    recent = recent_block(relative, compat).withColumnRenamed("time", "time_ref").drop("power", "relative_power")
    target = relative.select("time", "bidding_area", "power", "relative_power")

    sums = ensemble_sums(predictions).join(recent, ["time_ref", "bidding_area"]).join(target, ["time", "bidding_area"])
    capacity = F.col("operating_power_max")
    rows = sums.withColumns(
        {
            "mean_sum_pred": ratio(ensemble.array_mean(F.col("member_sums")), capacity),
            "std_sum_pred": ratio(ensemble.array_std(F.col("member_sums")), capacity),
            "min_sum_pred": ratio(F.array_min("member_sums"), capacity),
            "max_sum_pred": ratio(F.array_max("member_sums"), capacity),
        }
    )
    rows = with_transmission(settle(neighbours(rows.drop("member_sums")), "area_rows"), transmission)
    return rows.select(*KEYS, *AREA_FEATURES, *EMOS_FEATURES)
