"""Wide to long, grids and rasters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from forecastlab.session import settle
from forecastlab.sources.schemas import MEMBERS, WEATHER_VARIABLES

UNITS_PER_TILE = 512
TIMES_PER_TILE = 8192


def series_long(wide: DataFrame, time: str, value: str, name: str = "bidding_area") -> DataFrame:
    """One column per series to one row per time and series."""
    return wide.unpivot(time, [c for c in wide.columns if c != time], name, value)


def ensemble_array(variables: Sequence[str] = WEATHER_VARIABLES, members: Sequence[int] = MEMBERS) -> Column:
    """Member columns ``<variable>_<em>`` as one array of members."""
    return F.array(
        *[
            F.struct(
                F.lit(em).cast("int").alias("em"), *[F.col(f"{v}_{em:02d}").alias(v) for v in variables]
            )
            for em in members
        ]
    )


def ensemble_long(
    wide: DataFrame, ids: Sequence[str], variables: Sequence[str] = WEATHER_VARIABLES,
    members: Sequence[int] = MEMBERS,
) -> DataFrame:
    """Member columns ``<variable>_<em>`` to one row per member, from a single scan."""
    return wide.select(*ids, F.inline(ensemble_array(variables, members)))


def dense_grid(
    units: DataFrame, times: DataFrame, columns: Sequence[str] = ("time_ref", "time"), keep: Column | None = None,
    units_per_tile: int = UNITS_PER_TILE, times_per_tile: int = TIMES_PER_TILE,
) -> DataFrame:
    """Every unit at every distinct issue and valid time for which ``keep`` holds.

    Up to ``units_per_tile`` units, by their counted number, are broadcast and the calendar stays where it is. More units are dealt to lots, as is the
    calendar, both by their counted numbers, and the grid is made tile by tile: a tile is one lot of units at one lot of times, a bounded piece of work, and there are
    as many partitions as tiles. Units are copied once per lot of times and times once per lot of units, which is little beside the grid itself.
    ``keep`` is part of the join, so cells it rejects are never made.
    """
    spread = int(times.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    calendar = times.select(*columns).distinct()
    unit_lots = max(1, -(-units.count() // units_per_tile))
    if unit_lots == 1:
        left = calendar.repartition(spread, *columns).withColumn("_lot", F.pmod(F.xxhash64(*columns), F.lit(1)))
        right = F.broadcast(units.withColumn("_unit_lot", F.pmod(F.xxhash64(*units.columns), F.lit(1))))
        meet = F.col("_lot") == F.col("_unit_lot")
        return left.join(right, meet if keep is None else meet & keep).select(*units.columns, *columns)
    calendar = settle(calendar, "calendar")
    time_lots = max(1, -(-calendar.count() // times_per_tile))
    every = lambda lots: F.explode(F.sequence(F.lit(0), F.lit(lots - 1)))
    lot = lambda names, lots: F.pmod(F.xxhash64(*names), F.lit(lots)).cast("int")
    left = calendar.withColumn("_time_lot", lot(columns, time_lots)).withColumn("_lot", every(unit_lots))
    right = units.withColumn("_unit_lot", lot(units.columns, unit_lots)).withColumn("_unit_time", every(time_lots))
    tiles = max(spread, unit_lots * time_lots)
    left, right = left.repartition(tiles, "_lot", "_time_lot"), right.repartition(tiles, "_unit_lot", "_unit_time")
    meet = (F.col("_lot") == F.col("_unit_lot")) & (F.col("_time_lot") == F.col("_unit_time"))
    return left.join(right, meet if keep is None else meet & keep).select(*units.columns, *columns)


def array_rows(
    df: DataFrame, ids: Sequence[str], array: str, first_lead: int, name: str
) -> DataFrame:
    """Forecast arrays to one row per lead time, with the valid time."""
    opened = df.select(*ids, F.posexplode(array).alias("_i", name))
    lead = (F.col("_i") + first_lead).cast("long")
    return opened.select(
        *ids, lead.alias("lt"),
        F.timestamp_add("HOUR", lead.cast("int"), F.col("time_ref")).alias("time"), name,
    )


def bilinear(points: DataFrame, cells: DataFrame, point_id: str, fill: float | None = None) -> DataFrame:
    """Raster value at each point ``(id, x, y)`` from cells ``(ix, iy, value)`` on the unit grid.

    Each point asks for its four corners by key; a corner with no weight is not asked for. A point
    with a missing corner has no value, unless ``fill`` is given.
    """
    fx, fy = F.col("x") - F.floor("x"), F.col("y") - F.floor("y")

    def corner(dx: int, dy: int) -> Column:
        weight = (fx if dx else 1 - fx) * (fy if dy else 1 - fy)
        return F.struct(
            (F.floor("x") + dx).alias("ix"), (F.floor("y") + dy).alias("iy"), weight.alias("weight")
        )

    corners = F.filter(
        F.array(*[corner(dx, dy) for dx in (0, 1) for dy in (0, 1)]), lambda c: c["weight"] > 0
    )
    asked = points.select(point_id, F.inline(corners))
    met = asked.join(cells.select(F.col("ix").cast("long"), F.col("iy").cast("long"), "value"), ["ix", "iy"], "left")
    complete = F.count("value") == F.count(F.lit(1))
    summed = met.groupBy(point_id).agg(
        F.when(complete, F.sum(F.col("value") * F.col("weight"))).alias("value")
    )
    return summed if fill is None else summed.fillna(fill, ["value"])
