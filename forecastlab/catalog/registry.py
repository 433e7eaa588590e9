"""Registry of checked queries: each pairs a Spark query with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from forecastlab.catalog.lab import Lab
from forecastlab.catalog.views import compose

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    """Register ``function(lab) -> DataFrame`` under the operator's name, with its oracle if any."""

    def register(function: Callable[[Lab], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: function(Lab(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = compose(sql)
        return function

    return register
