"""Market messages: landed pages of nested JSON to flat outage tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from forecastlab.sources import schemas

# Fixed values of the message feed.
PRODUCTION, TRANSMISSION, MARKET = 1, 3, 5
UNPLANNED = 1
AREA_NAMES = ["NO1", "NO2", "NO3", "NO4"]
UNIT_FIELDS = ["name", "eic", "fuelType", "areaEic", "areaName", "installedCapacity", "timePeriods"]
PERIOD_FIELDS = ["unavailableCapacity", "availableCapacity", "eventStart", "eventStop"]


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row per landed page ``{total, items}``."""
    return spark.read.schema(schemas.PAGE).json(path)


def page_items(pages: DataFrame) -> DataFrame:
    return pages.select(F.inline("items"))


def page_completeness(pages: DataFrame) -> DataFrame:
    """Does the number of collected items reach the announced total?"""
    collected = F.coalesce(F.sum(F.size("items")), F.lit(0)).cast("long")
    return pages.agg(collected.alias("collected"), F.max("total").alias("total")).select(
        "collected", "total", (F.col("collected") >= F.col("total")).alias("complete")
    )


def as_time(name: str) -> Column:
    return F.expr(f"try_cast({name} AS TIMESTAMP)")


def _period_columns() -> list[Column]:
    return [
        F.col("period.unavailableCapacity").alias("unavailableCapacity"),
        F.col("period.availableCapacity").alias("availableCapacity"),
        as_time("period.eventStart").alias("eventStart"),
        as_time("period.eventStop").alias("eventStop"),
    ]


def production_outages(messages: DataFrame) -> DataFrame:
    """Type 1 messages without generation units, one row per unit and period."""
    return (
        messages.filter((F.col("messageType") == PRODUCTION) & F.col("generationUnits").isNull())
        .select(
            "messageId",
            (F.col("unavailabilityType") == UNPLANNED).alias("unplannedEvent"),
            as_time("publicationDate").alias("publicationDate"),
            F.explode_outer("productionUnits").alias("unit"),
        )
        .select(
            "messageId", "unplannedEvent", "publicationDate",
            F.col("unit.eic").alias("eic"),
            F.col("unit.installedCapacity").alias("installedCapacity"),
            F.explode_outer("unit.timePeriods").alias("period"),
        )
        .select("messageId", "unplannedEvent", "publicationDate", "eic", "installedCapacity", *_period_columns())
    )


def transmission_outages(
    messages: DataFrame, areas: Sequence[str] = AREA_NAMES, after: str = "2020-01-01"
) -> DataFrame:
    """Type 3 messages into the given areas, one row per unit and period that ends after a date."""
    return (
        messages.filter(F.col("messageType") == TRANSMISSION)
        .select(
            "messageId",
            (F.col("unavailabilityType") == UNPLANNED).alias("unplannedEvent"),
            as_time("publicationDate").alias("publicationDate"),
            F.explode("transmissionUnits").alias("unit"),
        )
        .filter(F.col("unit.outAreaName").isin(*areas))
        .select(
            "messageId", "unplannedEvent", "publicationDate",
            F.col("unit.outAreaName").alias("outAreaName"),
            F.col("unit.inAreaName").alias("inAreaName"),
            F.col("unit.installedCapacity").alias("installedCapacity"),
            F.explode("unit.timePeriods").alias("period"),
        )
        .select(
            "messageId", "unplannedEvent", "publicationDate", "outAreaName", "inAreaName",
            "installedCapacity", *_period_columns(),
        )
        .filter(F.col("eventStop") > F.lit(after).cast("timestamp"))
    )


def market_information(messages: DataFrame) -> DataFrame:
    """Type 5 messages, one row per area and asset; a message without assets keeps one null asset."""
    return (
        messages.filter(F.col("messageType") == MARKET)
        .select(
            "messageId", "remarks", "assets",
            as_time("eventStart").alias("eventStart"),
            as_time("eventStop").alias("eventStop"),
            as_time("publicationDate").alias("publicationDate"),
            F.explode_outer("areas").alias("area"),
        )
        .select(
            "messageId", "eventStart", "eventStop", "remarks", "publicationDate",
            F.col("area.name").alias("areaName"), F.col("area.code").alias("areaEic"),
            F.explode_outer("assets").alias("asset"),
        )
        .withColumns({"name": F.col("asset.name"), "eic": F.col("asset.code")})
        .drop("asset")
    )


def first_unit_outages(messages: DataFrame) -> DataFrame:
    """First production unit of each message, else its first generation unit, by period."""
    unit = F.when(F.col("productionUnits").isNotNull(), F.get("productionUnits", F.lit(0))).otherwise(
        F.get("generationUnits", F.lit(0))
    )
    return (
        messages.select("messageId", unit.alias("unit"))
        .select(
            "messageId",
            *[F.col(f"unit.{f}").alias(f) for f in ("name", "eic", "areaName", "installedCapacity")],
            F.explode_outer("unit.timePeriods").alias("period"),
        )
        .select("messageId", "name", "eic", "areaName", "installedCapacity", *_period_columns())
    )
