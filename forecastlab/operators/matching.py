"""Joins that look for partners by several keys, or for rows without one."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def any_key_join(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows that agree in at least one of several key pairs, each pair of rows once.

    One equi-join per key pair; a later one leaves out what an earlier one has found, so nothing has
    to be de-duplicated afterwards. Column names of the two sides must differ.
    """
    found: list[DataFrame] = []
    earlier: Column | None = None
    for left_key, right_key in pairs:
        same = F.col(left_key) == F.col(right_key)
        condition = same if earlier is None else same & ~earlier
        found.append(left.join(right, condition))
        matched = F.coalesce(same, F.lit(False))
        earlier = matched if earlier is None else earlier | matched
    return reduce(DataFrame.unionByName, found)


def full_match(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Full outer join that keeps both key columns."""
    return left.join(right, F.col(left_key) == F.col(right_key), "full_outer")


def unmatched(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows of either side without a partner."""
    both = full_match(left, right, left_key, right_key)
    return both.filter(F.col(left_key).isNull() | F.col(right_key).isNull())


def absent_from(df: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
    """Rows whose key does not occur in another table; a null key is not a member and stays."""
    members = other.select(F.col(other_key).alias("_member")).distinct()
    return df.join(members, F.col(key) == F.col("_member"), "left_anti")
