"""Ordered work on series that may be long or very uneven.

A plain window over ``(series)`` puts the whole series into one task. Everything here works on pieces
instead: a series is cut into time buckets or runs of rows, each piece is its own window partition,
and a small table with one row per piece carries sums, counts or last values to the next one.

Keys and order columns must not be null, and the order must be unique within a series.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from forecastlab.session import settle

CHUNK_ROWS = 4096


def month_of(time: str) -> Column:
    return F.date_trunc("MONTH", F.col(time))


def with_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, name: str = "pos"
) -> DataFrame:
    """Row number from 0 within each series, without sorting a series in one task.

    ``bucket`` must not decrease along ``order``. Rows are ranked inside their bucket and moved by
    the number of rows in earlier buckets.
    """
    cut = df.withColumn("_bucket", bucket)
    sizes = cut.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        cut.join(offsets, [*keys, "_bucket"])
        .withColumn(name, F.col("_offset") + F.row_number().over(inside) - 1)
        .drop("_bucket", "_offset")
    )


def global_position(df: DataFrame, order: Sequence[str], name: str = "pos") -> DataFrame:
    """Row number from 0 over the whole table.

    Rows are range partitioned on the order, which balances the ranges by sampling, and settled so
    that the ranges stay what they are; then each range is numbered on its own and moved by the rows
    before it.
    """
    ranged = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    return with_position(settle(ranged, "ranges"), [], order, F.col("_range"), name).drop("_range")


def frame_columns(
    df: DataFrame,
    keys: Sequence[str],
    *columns: Callable[[WindowSpec], dict[str, Column]],
    before: int = 0,
    after: int = 0,
    pos: str = "pos",
    chunk: int = CHUNK_ROWS,
) -> DataFrame:
    """Window columns whose frames reach at most ``before`` rows back and ``after`` rows ahead.

    A series is cut into runs of ``chunk`` rows. Rows near an edge are copied into the neighbouring
    run, so every frame is complete, and the copies are dropped afterwards. Several sets of columns
    are added one after the other on the same partitioning; ``before`` is then their sum.
    """
    chunk = max(chunk, before, after)
    home = F.floor(F.col(pos) / chunk)
    inside = F.col(pos) % chunk
    copies = F.array_compact(
        F.array(
            home,
            F.when(inside >= chunk - before, home + 1),
            F.when((inside < after) & (home > 0), home - 1),
        )
    )
    window = Window.partitionBy(*keys, "_chunk").orderBy(pos)
    cut = df.withColumn("_chunk", F.explode(copies))
    for step in columns:
        cut = cut.withColumns(step(window))
    return cut.filter(F.col("_chunk") == home).drop("_chunk")


def series_columns(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    *columns: Callable[[WindowSpec], dict[str, Column]],
    before: int = 0,
    after: int = 0,
    chunk: int = CHUNK_ROWS,
) -> DataFrame:
    """:func:`with_position` by month followed by :func:`frame_columns`."""
    placed = with_position(df, keys, [time], month_of(time), "_pos")
    return frame_columns(placed, keys, *columns, before=before, after=after, pos="_pos", chunk=chunk).drop("_pos")


def rolling(agg: Callable[[Column], Column], x: Column | str, rows: int, window: WindowSpec) -> Column:
    """Trailing aggregate that stays null until ``rows`` values are present."""
    x = F.col(x) if isinstance(x, str) else x
    frame = window.rowsBetween(-(rows - 1), 0)
    return F.when(F.count(x).over(frame) == rows, agg(x).over(frame))


def running_totals(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], bucket: Column
) -> DataFrame:
    """``cum_<value>``: inclusive running sums per series in two levels.

    Totals per bucket are accumulated on their small table, rows are accumulated inside a bucket.
    """
    cut = df.withColumn("_bucket", bucket)
    totals = cut.groupBy(*keys, "_bucket").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys, "_bucket", *[F.coalesce(F.sum(f"_t_{v}").over(earlier), F.lit(0)).alias(f"_c_{v}") for v in values]
    )
    inside = (
        Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        cut.join(carried, [*keys, "_bucket"])
        .withColumns(
            {
                f"cum_{v}": F.col(f"_c_{v}") + F.coalesce(F.sum(v).over(inside), F.lit(0))
                for v in values
            }
        )
        .drop("_bucket", *[f"_c_{v}" for v in values])
    )


def expanding_mean(df: DataFrame, keys: Sequence[str], time: str, value: str, name: str) -> DataFrame:
    """Mean of everything up to and including the row, so no later value leaks in."""
    counted = df.withColumns(
        {"_v": F.col(value).cast("double"), "_k": F.col(value).isNotNull().cast("long")}
    )
    summed = running_totals(counted, keys, [time], ["_v", "_k"], month_of(time))
    return summed.withColumn(name, F.try_divide("cum__v", "cum__k")).drop("_v", "_k", "cum__v", "cum__k")


def forward_fill(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], bucket: Column
) -> DataFrame:
    """Replace missing values by the last one seen in the series."""
    cut = df.withColumn("_bucket", bucket)
    when = F.struct(*order)
    last_seen = cut.groupBy(*keys, "_bucket").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), when)).alias(f"_l_{c}") for c in columns]
    )
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = last_seen.select(
        *keys, "_bucket",
        *[F.last(f"_l_{c}", ignorenulls=True).over(earlier).alias(f"_c_{c}") for c in columns],
    )
    inside = (
        Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        cut.join(carried, [*keys, "_bucket"])
        .withColumns(
            {c: F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"_c_{c}")) for c in columns}
        )
        .drop("_bucket", *[f"_c_{c}" for c in columns])
    )


def ewm_mean(
    df: DataFrame, keys: Sequence[str], time: str, values: dict[str, str], alpha: float,
    pos: str | None = None, means: dict[str, str] | None = None,
) -> DataFrame:
    """Exponentially weighted mean of whole series, in time linear in the rows.

    Inside a run of rows the weights ``(1 - alpha) ** -k`` grow with the row, so a plain running sum
    gives the weighted sums up to a factor that cancels in the quotient. A run is cut before the
    weights leave the range of a double; the sums of the run before it enter with the weight that
    belongs to their distance. Missing values get no weight but still take up a place; their own
    result is missing. ``means`` adds plain expanding means of other columns in the same pass.

    Numbered rows are settled first, because they are read twice (sums per run, and rows).
    """
    means = means or {}
    decay = -math.log1p(-alpha)
    run = max(2, int(300 / decay))
    placed = df if pos else settle(with_position(df, keys, [time], month_of(time), "_pos"), "positions")
    at = pos or "_pos"
    placed = placed.withColumn("_run", F.floor(F.col(at) / run))
    factor = F.exp(F.lit(decay) * (F.col(at) % run))
    sums = {}
    for out, x in values.items():
        sums[f"_n_{out}"] = F.col(x) * F.col("_w")
        sums[f"_d_{out}"] = F.when(F.col(x).isNotNull(), F.col("_w"))
    for out, x in means.items():
        sums[f"_n_{out}"] = F.col(x).cast("double")
        sums[f"_d_{out}"] = F.when(F.col(x).isNotNull(), F.lit(1.0))
    # Totals are added up before they move; rows move without the terms of the sums.
    totals = placed.withColumn("_w", factor).withColumns(sums).groupBy(*keys, "_run").agg(*[F.sum(c).alias(f"_t{c}") for c in sums])
    earlier = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys, "_run",
        *[F.last(f"_t_{k}_{out}", ignorenulls=True).over(earlier).alias(f"_c_{k}_{out}") for out in values for k in "nd"],
        *[F.sum(f"_t_{k}_{out}").over(earlier).alias(f"_c_{k}_{out}") for out in means for k in "nd"],
        *[
            F.last(F.when(F.col(f"_t_d_{out}").isNotNull(), F.col("_run")), ignorenulls=True)
            .over(earlier).alias(f"_from_{out}")
            for out in values
        ],
    )
    inside = Window.partitionBy(*keys, "_run").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    result = {}
    for out, x in values.items():
        num, den = F.sum(f"_n_{out}").over(inside), F.sum(f"_d_{out}").over(inside)
        distance = (F.col("_run") - F.col(f"_from_{out}")) * run
        weight = F.exp(F.lit(-decay) * distance)
        old_num = F.coalesce(F.col(f"_c_n_{out}") * weight, F.lit(0.0))
        old_den = F.coalesce(F.col(f"_c_d_{out}") * weight, F.lit(0.0))
        result[out] = F.when(F.col(x).isNotNull(), (num + old_num) / (den + old_den))
    for out in means:
        total = F.coalesce(F.sum(f"_n_{out}").over(inside), F.lit(0.0)) + F.coalesce(f"_c_n_{out}", F.lit(0.0))
        count = F.coalesce(F.sum(f"_d_{out}").over(inside), F.lit(0.0)) + F.coalesce(f"_c_d_{out}", F.lit(0.0))
        result[out] = F.try_divide(total, count)
    extra = ["_run", "_w", *sums, *[f"_c{c}" for c in sums], *[f"_from_{o}" for o in values]]
    dealt = placed.repartition(*keys, "_run").withColumn("_w", factor).withColumns(sums)
    return (
        dealt.join(carried, [*keys, "_run"])
        .withColumns(result)
        .drop(*extra, *([] if pos else ["_pos"]))
    )


def ewm_span(span: float) -> float:
    return 2.0 / (span + 1.0)


def hour_spine(df: DataFrame, keys: Sequence[str], time: str, step: str = "1 hour") -> DataFrame:
    """Every step between the first and last time of each series."""
    bounds = df.groupBy(*keys).agg(F.min(time).alias("_from"), F.max(time).alias("_to"))
    grid = F.expr(f"explode(sequence(_from, _to, INTERVAL {step}))")
    return bounds.select(*keys, grid.alias(time))


def fill_gaps(
    df: DataFrame, keys: Sequence[str], time: str, columns: Sequence[str], step: str = "1 hour"
) -> DataFrame:
    """Regular series: spine, left join, last value carried forward."""
    spread = settle(hour_spine(df, keys, time, step).join(df, [*keys, time], "left"), "spine")
    return forward_fill(spread, keys, [time], columns, month_of(time))


def issue_arrays(
    df: DataFrame, keys: Sequence[str], time: str, value: str,
    lookback: int, lead: int, window: int, issue_hour: int = 9,
) -> DataFrame:
    """Lookback and target arrays around every daily issue time of a regular hourly series.

    A row is sent to the few issue times it belongs to, and each issue time collects
    ``lookback + window`` values: no frame is scanned for hours that issue nothing.
    """
    offsets = F.filter(
        F.sequence(F.lit(-(lookback - 1)), F.lit(lead + window - 1)),
        lambda d: (F.pmod(F.hour(time) - d, F.lit(24)) == issue_hour) & ((d <= 0) | (d >= lead)),
    )
    sent = df.filter(F.col(value).isNotNull()).select(
        *keys, F.col(time).alias("_t"), F.col(value).alias("_x"), F.explode(offsets).alias("_d")
    )
    grouped = sent.groupBy(*keys, F.timestamp_add("HOUR", -F.col("_d"), F.col("_t")).alias("time_ref")).agg(
        F.array_sort(F.collect_list(F.when(F.col("_d") <= 0, F.struct("_d", "_x")))).alias("_past"),
        F.array_sort(F.collect_list(F.when(F.col("_d") >= lead, F.struct("_d", "_x")))).alias("_next"),
    )
    return grouped.filter((F.size("_past") == lookback) & (F.size("_next") == window)).select(
        *keys, "time_ref",
        F.transform("_past", lambda s: s["_x"]).alias("lookback"),
        F.transform("_next", lambda s: s["_x"]).alias("target"),
    )


def gaps(df: DataFrame, time: str, hours: int) -> DataFrame:
    """Distinct times that come more than ``hours`` after the one before."""
    def step(window: WindowSpec) -> dict[str, Column]:
        before = F.lag(time).over(window)
        return {"hours_since_last": F.floor((F.unix_seconds(time) - F.unix_seconds(before)) / 3600)}

    stepped = series_columns(df.select(time).distinct(), [], time, step, before=1)
    return stepped.filter(F.col("hours_since_last") > hours)
