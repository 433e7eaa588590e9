"""Expanding blocks, time splits and the check that nothing leaks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Window, functions as F

from forecastlab.functions.scalars import add_days, is_day_ahead
from forecastlab.operators.series import global_position, month_of

FAR_FUTURE = "9999-01-01"
BEFORE_ALL = "0001-01-01"


def month_starts(data: DataFrame, target: str, first: str | None = None) -> DataFrame:
    """First issue time with a target in each calendar month; one row per month of history."""
    known = data.filter(F.col(target).isNotNull())
    if first is not None:
        known = known.filter(F.col("time_ref") >= F.lit(first).cast("timestamp"))
    return known.groupBy(month_of("time_ref").alias("month")).agg(F.min("time_ref").alias("start"))


def block_bounds(starts: DataFrame) -> DataFrame:
    """Blocks ``[start, stop)``; the last one is open. One row per month, so one window is enough."""
    following = F.lead("start").over(Window.orderBy("start"))
    return starts.select("start", F.coalesce(following, F.lit(FAR_FUTURE).cast("timestamp")).alias("stop"))


def with_blocks(
    data: DataFrame, target: str, first: str | None = None, starts: DataFrame | None = None
) -> DataFrame:
    """Rows with ``block``: predicted in that block, trained on by every later one.

    Rows before the first block get the earliest time. The starts are a list of months (twelve a
    year, whatever the size of the data) that each row looks up, so no row is shuffled.
    """
    months = month_starts(data, target, first) if starts is None else starts
    listed = months.agg(F.array_sort(F.collect_list("start"))).scalar()
    passed = F.filter("_starts", lambda s: s <= F.col("time_ref"))
    block = F.coalesce(F.try_element_at(passed, F.lit(-1)), F.lit(BEFORE_ALL).cast("timestamp"))
    return data.withColumn("_starts", listed).withColumn("block", block).drop("_starts")


def rolling_models(
    data: DataFrame, target: str, first: str, fit: Callable[[DataFrame], Any], predict: Callable[[Any, DataFrame], DataFrame],
    fit_on: DataFrame | None = None,
) -> DataFrame:
    """Every block predicted by a model of any kind that was trained on all rows before it.

    ``fit`` takes the training rows of a block and returns a model, ``predict`` takes the model and the block's rows. There is one
    distributed fit per month of history (the list of months is what reaches the driver); linear models get all their fits from one pass in
    :func:`forecastlab.plans.moments.rolling_prediction`. ``data`` is read once per block, so hand in a settled table.
    """
    known = (data if fit_on is None else fit_on).filter(F.col(target).isNotNull())
    starts = sorted(row["start"] for row in month_starts(known, target, first).collect())
    at, parts = F.col("time_ref"), []
    for start, stop in zip(starts, [*starts[1:], None]):
        rows = data.filter(at >= F.lit(start)) if stop is None else data.filter((at >= F.lit(start)) & (at < F.lit(stop)))
        parts.append(predict(fit(known.filter(at < F.lit(start))), rows))
    return reduce(DataFrame.unionByName, parts)


def block_summary(data: DataFrame, target: str, first: str | None = None) -> DataFrame:
    """Training and prediction rows of each block and the times that separate them."""
    per_block = with_blocks(data, target, first).groupBy("block").agg(
        F.count(F.lit(1)).alias("n_pred"), F.count(target).alias("_known"),
        F.min("time_ref").alias("first_pred"),
        F.max(F.when(F.col(target).isNotNull(), F.col("time_ref"))).alias("_last"),
    )
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return per_block.select(
        F.col("block").alias("start"),
        F.coalesce(F.sum("_known").over(earlier), F.lit(0)).alias("n_train"), "n_pred",
        F.max("_last").over(earlier).alias("last_train"), "first_pred",
    ).filter(F.col("start") > F.lit(BEFORE_ALL).cast("timestamp"))


def leak_check(train: DataFrame, pred: DataFrame, time_ref: str = "time_ref") -> DataFrame:
    """One row: does any prediction row lie at or before the last training row?"""
    last = train.agg(F.max(time_ref)).scalar()
    return pred.agg(F.min(time_ref).alias("first_pred")).select(
        last.alias("last_train"), "first_pred", (last >= F.col("first_pred")).alias("leak")
    )


def guard(pred: DataFrame, train: DataFrame, time_ref: str = "time_ref") -> DataFrame:
    """Prediction rows that raise an error when read if they do not come after the training rows."""
    last = train.agg(F.max(time_ref)).scalar()
    message = F.lit("prediction rows must come after the last training row")
    safe = F.when(last >= F.col(time_ref), F.raise_error(message).cast("timestamp")).otherwise(F.col(time_ref))
    return pred.withColumn(time_ref, safe)


def holdout(
    data: DataFrame, start: str, target: str = "local_relative_power", weight: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Member 0 before a date to train, day-ahead rows from it on to validate; weight 1 by default."""
    at = F.lit(start).cast("timestamp")
    known = data.filter(F.col(target).isNotNull() & (F.col("lt") > 0)).withColumn(
        "sample_weight", F.lit(1.0) if weight is None else F.col(weight)
    )
    train = known.filter((F.col("time_ref") < at) & (F.col("em") == 0))
    return train, known.filter((F.col("time_ref") >= at) & is_day_ahead("time", "time_ref"))


def purged_split(
    data: DataFrame, order: list[str], train_share: float = 0.75, gap: int = 0
) -> DataFrame:
    """``part``: the first share of rows in time, then a gap, then the rest.

    Rows are numbered in ranges, so no task sorts all of them.
    """
    placed = global_position(data, order, "_pos")
    total = placed.agg(F.max("_pos") + 1).scalar()
    cut = F.floor(total * F.lit(train_share))
    part = (
        F.when(F.col("_pos") < cut, "train").when(F.col("_pos") < cut + gap, "gap").otherwise("validation")
    )
    return placed.withColumn("part", part).drop("_pos")


def train_year(data: DataFrame, truth: DataFrame, target: str, days: int = 365) -> DataFrame:
    """Rows with a target in the year before the first evaluation issue time."""
    cutoff = truth.agg(F.min("time_ref")).scalar()
    return data.filter(
        (F.col("time_ref") < cutoff) & (F.col("time_ref") >= add_days(cutoff, -days))
        & F.col(target).isNotNull()
    )
