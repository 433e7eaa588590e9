"""Table summaries: one pass each, whatever the number of columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def _per_column(df: DataFrame, columns: Sequence[str], stats: dict) -> DataFrame:
    """One aggregate row over all columns, opened to one row per column."""
    packed = [
        F.struct(F.lit(c).alias("feature"), *[make(F.col(f"`{c}`")).alias(name) for name, make in stats.items()])
        for c in columns
    ]
    return df.agg(F.array(*packed).alias("_rows")).select(F.inline("_rows"))


def missing_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows, missing values and range of each feature, as checked before a fit."""
    return _per_column(
        df, columns,
        {
            "n": lambda c: F.count(F.lit(1)),
            "missing": lambda c: F.count_if(c.isNull() | F.isnan(c.cast("double"))),
            "low": F.min,
            "high": F.max,
        },
    )


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Summary statistics of numeric features."""
    return _per_column(
        df, columns,
        {
            "n": F.count,
            "missing": lambda c: F.count_if(c.isNull()),
            "mean": F.avg,
            "std": F.stddev_samp,
            "low": F.min,
            "high": F.max,
        },
    )


def sample_keys(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """``n`` distinct keys in the order of a hash: the same keys on every run and partitioning."""
    distinct = df.select(*keys).distinct()
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    return distinct.orderBy(F.md5(text), *keys).limit(n)
