"""Exact order statistics without bringing a group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from forecastlab.operators.series import running_totals
from forecastlab.session import settle

ACCURACY = 10_000


def _ranges(counted: DataFrame, order: Sequence[str], label: str) -> DataFrame:
    """``counted`` in ranges of about equal numbers of rows along ``order``, settled so that they stay what they are.

    Spark samples the borders, and there are as many ranges as the data fills partitions.
    """
    return settle(counted.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), label)


def _present(value: str) -> Column:
    """Values that take part: NaN counts as missing, in counts and ranks alike."""
    return F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float]
) -> DataFrame:
    """Linearly interpolated quantiles per group, plus the count ``n`` of values that are neither null nor NaN.

    A mergeable sketch first brackets every quantile. Values below and above a bracket become one row
    each, with their count and the value next to the bracket; what lies inside is counted by value and ranked. The
    bracket is wider than the sketch's error; should a wanted rank still lie beyond it and its neighbours, the query fails
    instead of giving another value. The brackets are settled, so Spark sees their size and can broadcast them instead of
    moving the rows of a large group together. Groups of all sizes take the same way.
    """
    names, qs = list(quantiles), list(quantiles.values())
    present = df.filter(_present(value)).select(*keys, F.col(value).cast("double").alias("_v"))
    margin = 3.0 / ACCURACY

    def sketch(points: list[float]) -> Column:
        return F.percentile_approx("_v", F.array(*[F.lit(p) for p in points]), ACCURACY)

    brackets = present.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        sketch([max(0.0, q - margin) for q in qs]).alias("_lo"),
        sketch([min(1.0, q + margin) for q in qs]).alias("_hi"),
    )
    brackets = settle(brackets, "brackets")
    if keys:
        tied = present.join(brackets, list(keys))
    else:
        one = brackets.select(F.struct("n", "_lo", "_hi")).scalar()
        tied = present.withColumn("_one", one).select("_v", "_one.*")
    v = F.col("_v")
    cells = F.array(
        *[
            F.struct(
                F.lit(i).alias("_q"),
                F.when(v < F.col("_lo")[i], -1).when(v > F.col("_hi")[i], 1).otherwise(0).alias("_side"),
                F.when((v >= F.col("_lo")[i]) & (v <= F.col("_hi")[i]), v).alias("_cell"),
            )
            for i in range(len(qs))
        ]
    )
    counted = (
        tied.select(*keys, "n", "_v", F.inline(cells))
        .groupBy(*keys, "n", "_q", "_side", "_cell")
        .agg(F.count(F.lit(1)).alias("_k"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    )
    counted = _ranges(counted, [*keys, "_q", "_side", "_cell"], "counts")
    ranked = running_totals(counted, [*keys, "_q"], ["_side", "_cell"], ["_k"], F.col("_range"))
    q = F.element_at(F.array(*[F.lit(x) for x in qs]), F.col("_q") + 1)
    place = q * (F.col("n") - 1)

    def at(index: Column) -> Column:
        first, after = F.col("cum__k") - F.col("_k"), F.col("cum__k")
        known = (
            F.when(F.col("_side") == 0, F.col("_cell"))
            .when((F.col("_side") < 0) & (index == after - 1), F.col("_most"))
            .when((F.col("_side") > 0) & (index == first), F.col("_least"))
            .otherwise(F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double"))
        )
        return F.max(F.when((index >= first) & (index < after), known))

    ends = ranked.withColumn("_h", place).groupBy(*keys, "n", "_q", "_h").agg(
        at(F.floor("_h")).alias("_below"), at(F.ceil("_h")).alias("_above")
    )
    between = F.col("_below") + (F.col("_above") - F.col("_below")) * (F.col("_h") - F.floor("_h"))
    return ends.groupBy(*keys, "n").agg(
        *[F.max(F.when(F.col("_q") == i, between)).alias(name) for i, name in enumerate(names)]
    )


def two_sample_ks(df: DataFrame, value: str, is_first: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic and its asymptotic p-value.

    Counts per distinct value are added before the shuffle; cumulative shares run in ranges that Spark
    balances by sampling, so no task sorts all values. NaN counts as missing.
    """
    keys = list(keys)
    flagged = df.filter(_present(value)).select(
        *keys, F.col(value).alias("_v"), is_first.cast("long").alias("_a"), (~is_first).cast("long").alias("_b")
    )
    by_value = flagged.groupBy(*keys, "_v").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    by_value = _ranges(by_value, [*keys, "_v"], "counts")
    summed = running_totals(by_value, keys, ["_v"], ["_a", "_b"], F.col("_range"))
    totals = by_value.groupBy(*keys).agg(F.sum("_a").alias("n1"), F.sum("_b").alias("n2"))
    if keys:
        joined = summed.join(totals, keys)
    else:
        joined = summed.withColumns(
            {
                "n1": by_value.agg(F.sum("_a")).scalar(),
                "n2": by_value.agg(F.sum("_b")).scalar(),
            }
        )
    distance = F.abs(F.col("cum__a") / F.col("n1") - F.col("cum__b") / F.col("n2"))
    result = joined.groupBy(*keys, "n1", "n2").agg(F.max(distance).alias("ks"))
    scaled = F.col("ks") * F.sqrt(F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2")))
    tail = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)),
        F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * scaled * scaled),
    )
    p = F.when(scaled < 0.2, F.lit(1.0)).otherwise(F.greatest(F.least(tail, F.lit(1.0)), F.lit(0.0)))
    return result.withColumn("p_value", p)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row per key in an explicit order, by a mergeable aggregate instead of a window.

    Partial results are combined before the shuffle, so a key with very many rows costs one row per
    map task.
    """
    others = [c for c in df.columns if c not in keys]
    sort_key = F.struct(*[F.col(o).alias(f"_o{i}") if isinstance(o, str) else o.alias(f"_o{i}") for i, o in enumerate(order)])
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*others), sort_key).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The ``k`` first rows of each key. Spark cuts each map task to ``k`` rows before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")
