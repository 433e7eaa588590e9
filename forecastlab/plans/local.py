"""Local data set: one row per ``(time_ref, time, unit, member)`` with 36 features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from forecastlab.functions import physics, seasons
from forecastlab.functions.scalars import ratio
from forecastlab.operators.intervals import covered_cells, visible_totals
from forecastlab.operators.reshape import dense_grid, ensemble_array
from forecastlab.operators.series import ewm_mean
from forecastlab.session import settle
from forecastlab.sources.schemas import MEMBERS, WEATHER_VARIABLES

# The feature list of the unit model.
LOCAL_FEATURES = [
    "lt", "mean_hub_height", "mean_rotor_diameter", "unavailable_capacity", "elevation", "ruggedness",
    "ELSPOT NO1", "ELSPOT NO2", "ELSPOT NO3", "ELSPOT NO4", "sin_hod", "cos_hod", "sin_doy", "cos_doy",
    "location_mean_ws", "now_air_temperature_2m", "now_air_pressure_at_sea_level",
    "now_relative_humidity_2m", "now_precipitation_amount", "now_wind_speed_10m",
    "now_wind_direction_10m", "now_air_density", "now_wind_alignment", "now_wind_power_density",
    "ws10m", "wd10m", "t2m", "rh2m", "mslp", "g10m", "wshh", "adhh", "phh", "wind_power_density",
    "wind_alignment", "gust_factor",
]
KEYS = [
    "time_ref", "time", "windpark", "bidding_area", "em", "local_power", "local_relative_power",
    "operating_power_max", "mean_production", "num_turbines",
]


def nowcast_columns(nowcast: DataFrame) -> DataFrame:
    """Station and issue time, every other column prefixed."""
    others = [c for c in nowcast.columns if c not in ("windpark", "time")]
    return nowcast.select(
        F.col("windpark").alias("windpark_statnet"), F.col("time").alias("time_ref"),
        *[F.col(c).alias(f"now_{c}") for c in others],
    )


def nowcast_features(nowcast: DataFrame, leak_free: bool = True, asked: DataFrame | None = None) -> DataFrame:
    """Nowcast with wind vector, density, station mean speed and smoothed alignment.

    ``leak_free`` uses the mean up to the issue time; otherwise the mean of all time is used, which
    knows the future. ``asked`` (``time_ref``, each once) are the issue times whose rows are returned, if not all: other rows take part in the sums only, and
    move without the columns that no sum reads.
    """
    station, speed = "windpark_statnet", "now_wind_speed_10m"
    base = nowcast_columns(nowcast).withColumns(
        {
            "now_wind_x": physics.wind_x(speed, "now_wind_direction_10m"),
            "now_wind_y": physics.wind_y(speed, "now_wind_direction_10m"),
            "now_air_density": physics.air_density("now_air_pressure_at_sea_level", "now_air_temperature_2m"),
        }
    )
    rest = [c for c in base.columns if c not in (station, "time_ref", "now_wind_x", "now_wind_y", speed)]
    if asked is not None:
        flagged = base.join(F.broadcast(asked.select("time_ref", F.lit(True).alias("_asked"))), "time_ref", "left")
        base = flagged.select(station, "time_ref", "now_wind_x", "now_wind_y", speed, F.when(F.col("_asked"), F.struct(*rest)).alias("_rest"))
    smooth = ewm_mean(
        base, [station], "time_ref", {"ewm_now_wind_x": "now_wind_x", "ewm_now_wind_y": "now_wind_y"}, 0.5,
        means={"location_mean_ws": speed},
    )
    if not leak_free:
        smooth = station_mean(smooth.drop("location_mean_ws"), station, speed)
    if asked is not None:
        smooth = smooth.filter(F.col("_rest").isNotNull()).select("*", "_rest.*").drop("_rest")
    return smooth.withColumns(
        {
            "now_wind_alignment": physics.vector_length(F.col("ewm_now_wind_x"), F.col("ewm_now_wind_y")),
            "now_wind_power_density": physics.power_density("now_air_density", speed),
        }
    )


def station_mean(df: DataFrame, station: str, value: str, name: str = "location_mean_ws") -> DataFrame:
    """Mean over all time of each station, beside every row.

    Grouped and joined back: partial means are combined before the shuffle, and no station has to
    fit in one task as it would in a window. The means are settled, so that Spark knows their size.
    """
    means = settle(df.groupBy(station).agg(F.avg(value).alias(name)), "means")
    return df.join(means, station, "left")


def outage_share(asked: DataFrame, outages: DataFrame, key: str = "windpark_nve_id") -> DataFrame:
    """Share of capacity reported unavailable at each asked ``(key, time_ref, time)``, as known at issue time; absent without a message."""
    known = visible_totals(asked, outages, [key], ["unavailableCapacity", "installedCapacity"])
    return known.select(
        key, "time_ref", "time", ratio("unavailableCapacity", "installedCapacity").alias("unavailable_capacity")
    )


def with_outages(df: DataFrame, outages: DataFrame, key: str = "windpark_nve_id") -> DataFrame:
    """Settled rows with the share of capacity reported unavailable; 0 without a message."""
    share = outage_share(df, outages, key)
    return df.join(share, [key, "time_ref", "time"], "left").fillna(0.0, ["unavailable_capacity"])


def unit_facts(unit_power: DataFrame, outages: DataFrame, calendar: DataFrame, key: str = "windpark_nve_id") -> DataFrame:
    """What is known of a unit alone, one row per ``(key, time_ref)``: its production and outage shares at the valid times of the issue that have any.

    ``calendar`` is settled. Only times with a value are listed, so this grows with production and messages and not with the grid.
    """
    power = unit_power.join(F.broadcast(calendar.select("time").distinct()), "time", "left_semi").join(calendar, "time")
    share = outage_share(settle(covered_cells(outages, calendar, [key]), "covered"), outages, key)
    both = power.select(key, "time_ref", F.struct("time", "local_power").alias("_p")).unionByName(
        share.select(key, "time_ref", F.struct("time", "unavailable_capacity").alias("_s")), allowMissingColumns=True
    )
    return both.groupBy(key, "time_ref").agg(F.collect_list("_p").alias("_power"), F.collect_list("_s").alias("_share"))


def unit_cells(units: DataFrame, unit_power: DataFrame, nowcast: DataFrame, outages: DataFrame, calendar: DataFrame, leak_free: bool = True) -> DataFrame:
    """The grid with what does not depend on the member.

    Joined per unit and issue; valid times are opened after that, where the rows are, so no join moves a row per cell.
    The result is dealt and sorted by station and issue.
    """
    issues = settle(calendar.groupBy("time_ref").agg(F.collect_list("time").alias("_times")), "issues")
    now = nowcast_features(nowcast, leak_free, issues)
    grid = unit_grid(units, issues, ["time_ref"]).join(unit_facts(unit_power, outages, calendar), ["windpark_nve_id", "time_ref"], "left")
    cells = grid.join(now, ["windpark_statnet", "time_ref"], "left").join(F.broadcast(issues), "time_ref")
    cells = cells.withColumn("time", F.explode("_times"))
    at = lambda name: F.filter(name, lambda p: p["time"] == F.col("time"))
    # Like a left join: a row per match, one without a match.
    cells = cells.withColumn("_p", F.explode_outer(at("_power"))).withColumns(
        {
            "local_power": F.col("_p")["local_power"],
            "unavailable_capacity": F.coalesce(F.try_element_at(at("_share"), F.lit(1))["unavailable_capacity"], F.lit(0.0)),
        }
    )
    return cells.drop("_times", "_power", "_share", "_p")


def unit_grid(units: DataFrame, times: DataFrame, columns: Sequence[str] = ("time_ref", "time")) -> DataFrame:
    """Units at every issue (and valid time) after they started; the start is part of the join."""
    return dense_grid(units, times, columns, keep=F.col("time_ref") > F.col("production_start_date"))


def station_alignment(forecast: DataFrame) -> DataFrame:
    """Forecast with ``alignment_10m``, the alignment of the 10 m wind over neighbouring lead times.

    Speed at hub height is the 10 m speed times a factor of the unit alone, so the alignment at hub
    height is this one times the same factor. Computing it per station keeps the window off the
    unit rows, which are wider and more. The member is part of the partition, so a frame never mixes
    members of equal lead time.
    """
    window = Window.partitionBy("windpark_statnet", "time_ref", "em").orderBy("lt")
    return forecast.withColumn("alignment_10m", physics.wind_alignment("ws10m", window))


def wide_alignment(forecast: DataFrame) -> DataFrame:
    """The same for a forecast with its members side by side, which become an array ``_members``: one row per station, issue and valid time."""
    window = Window.partitionBy("windpark_statnet", "time_ref").orderBy("lt")
    aligned = forecast.withColumns(
        {f"alignment_10m_{em:02d}": physics.wind_alignment(f"ws10m_{em:02d}", window, f"wd10m_{em:02d}") for em in MEMBERS}
    )
    return aligned.select(
        F.col("windpark_statnet").alias("_station"), F.col("time_ref").alias("_issue"), F.col("time").alias("_time"), "lt",
        ensemble_array([*WEATHER_VARIABLES, "alignment_10m"]).alias("_members"),
    )


def with_members(cells: DataFrame, forecast: DataFrame) -> DataFrame:
    """Cells with the forecast of every member, or one row without any where there is none.

    A wide forecast meets the cells by station and issue, the key it is windowed by, so it moves and is sorted once; valid times are compared there,
    and members become rows after that. The difference keeps the valid time out of the join's key, by which both sides would be dealt again.
    The size of a forecast made by an aggregate is guessed too low, so it is kept from being broadcast.
    """
    if "em" in forecast.columns:
        return cells.join(station_alignment(forecast), ["windpark_statnet", "time_ref", "time"], "left")
    same = F.unix_micros("time") - F.unix_micros("_time") == 0
    met = cells.join(
        wide_alignment(forecast).hint("merge"), (F.col("windpark_statnet") == F.col("_station")) & (F.col("time_ref") == F.col("_issue")) & same, "left"
    ).drop("_station", "_issue", "_time")
    return met.select(*[c for c in met.columns if c != "_members"], F.inline_outer("_members"))


def local_dataset(
    units: DataFrame, unit_power: DataFrame, forecast: DataFrame, nowcast: DataFrame, outages: DataFrame,
    leak_free: bool = True, calendar: DataFrame | None = None,
) -> DataFrame:
    """The whole local table, unsorted; write it with ``write_parquet(sort_by=...)``.

    ``forecast`` has its members side by side, or a row per member. What depends on the unit and time alone (power, outages, nowcast,
    season) comes before the members, so those joins move one row per unit and issue and not one per member. ``calendar``: the distinct issue and valid times
    of the forecast, where they are known.
    """
    calendar = settle(forecast.select("time_ref", "time").distinct() if calendar is None else calendar, "calendar")
    cells = unit_cells(units, unit_power, nowcast, outages, calendar, leak_free).withColumns(
        {
            **seasons.season("time"),
            **seasons.area_dummies(),
            "local_relative_power": ratio("local_power", "operating_power_max"),
            "windpark": F.col("windpark_nve"),
        }
    )
    rows = with_members(cells, forecast).withColumns(
        {"gust_factor": physics.gust_factor(), **physics.hub_air(), "wind_alignment": physics.hub_speed("alignment_10m")}
    )
    return rows.select(*KEYS, *[F.col(f"`{c}`") for c in LOCAL_FEATURES])
