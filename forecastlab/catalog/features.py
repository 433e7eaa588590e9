"""Feature functions and data sets (survey 2.9)."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from forecastlab.catalog.aggregates import OFF_EDGE
from forecastlab.catalog.joins import area_cells, unit_cells
from forecastlab.catalog.registry import check
from forecastlab.catalog.rows import SEASON_RAW, SEASON_SQL, r6, rounded
from forecastlab.catalog.views import HUB_AIR
from forecastlab.catalog.windows import geo_sites
from forecastlab.functions import physics, seasons
from forecastlab.functions.scalars import round_to
from forecastlab.operators.reshape import bilinear
from forecastlab.plans import area, design, local, units
from forecastlab.session import settle
from forecastlab.sources.files import register_columns
from forecastlab.sources.schemas import MEMBERS, WEATHER_VARIABLES

SITE = ["windpark_nve_id", "time_ref", "lt"]


def each_member(sql: str) -> str:
    """The SQL text once per member; ``{em}`` stands for its two digits."""
    return ", ".join(sql.replace("{em}", f"{em:02d}") for em in MEMBERS)


def site_wide(lab):
    """The forecast of all members at each unit."""
    return lab.site_forecast(lab.units.select("windpark_nve_id", "windpark_statnet", "mean_hub_height", "elevation"))


SITE_SQL = "v_forecast_wide JOIN v_units ON sid = windpark_statnet"
STATION = ["sid", "time_ref", "lt"]


@check("feat_hub_speed", f"""
SELECT windpark_nve_id, time_ref, lt, {each_member("round(ws10m_{em} * pow(mean_hub_height / 10, 0.143), 6) AS wshh_{em}")} FROM {SITE_SQL}""")
def _(lab):
    return site_wide(lab).select(*SITE, *[r6(physics.hub_speed(f"ws10m_{em:02d}")).alias(f"wshh_{em:02d}") for em in MEMBERS])


AIR_STEPS = """
t2m_{em} + 273.15 - 0.0065 * mean_hub_height AS layer_{em}, rh2m_{em} / 100 * (6.112 * exp((17.67 * t2m_{em}) / (t2m_{em} + 243.5))) * 100 AS e_{em},
mslp_{em} * 100 * exp(-9.80665 * elevation / (287.05 * layer_{em})) AS p0_{em},
layer_{em} * (1 + 0.61 * (0.622 * e_{em} / (p0_{em} - 0.378 * e_{em}))) AS tv_{em},
mslp_{em} * 100 * exp(-9.80665 * (elevation + mean_hub_height) / (287.05 * tv_{em})) AS phh_{em},
phh_{em} / (287.05 * tv_{em}) AS adhh_{em}, ws10m_{em} * pow(mean_hub_height / 10, 0.143) AS wshh_{em},
0.5 * adhh_{em} * pow(least(greatest(wshh_{em}, 0), 25), 3) AS wind_power_density_{em}"""


@check("feat_hub_air", f"""
SELECT windpark_nve_id, time_ref, lt, {each_member("round(wshh_{em}, 6) AS wshh_{em}, round(adhh_{em}, 6) AS adhh_{em}, "
       "round(phh_{em}, 3) AS phh_{em}, round(wind_power_density_{em}, 4) AS wind_power_density_{em}")}
FROM (SELECT windpark_nve_id, time_ref, lt, {each_member(AIR_STEPS)} FROM {SITE_SQL})""")
def _(lab):
    digits = {"wshh": 6, "adhh": 6, "phh": 3, "wind_power_density": 4}
    air = {em: physics.hub_air(*[f"{v}_{em:02d}" for v in ("ws10m", "t2m", "rh2m", "mslp")]) for em in MEMBERS}
    return site_wide(lab).select(*SITE, *[F.round(c, digits[n]).alias(f"{n}_{em:02d}") for em in MEMBERS for n, c in air[em].items()])


@check("feat_air_density", f"""
SELECT sid, time_ref, lt, {each_member("round(mslp_{em} / (273.15 + t2m_{em}), 6) AS air_density_{em}")} FROM v_forecast_wide""")
def _(lab):
    return lab.forecast_wide.select(
        *STATION, *[r6(physics.air_density(f"mslp_{em:02d}", f"t2m_{em:02d}")).alias(f"air_density_{em:02d}") for em in MEMBERS]
    )


@check("feat_power_density", f"""
SELECT sid, time_ref, lt, {each_member("round(mslp_{em} / (273.15 + t2m_{em}) * pow(least(greatest(ws10m_{em}, 0), 20), 3), 6) AS density_{em}")}
FROM v_forecast_wide""")
def _(lab):
    density = {em: physics.power_density(physics.air_density(f"mslp_{em:02d}", f"t2m_{em:02d}"), f"ws10m_{em:02d}") for em in MEMBERS}
    return lab.forecast_wide.select(*STATION, *[r6(density[em]).alias(f"density_{em:02d}") for em in MEMBERS])


@check("feat_vector_xy", f"""
SELECT sid, time_ref, lt, {each_member("round(ws10m_{em} * cos(2 * pi() * wd10m_{em} / 360), 6) AS wind_x_{em}, "
       "round(ws10m_{em} * sin(2 * pi() * wd10m_{em} / 360), 6) AS wind_y_{em}")} FROM v_forecast_wide""")
def _(lab):
    wind = lambda em: (f"ws10m_{em:02d}", f"wd10m_{em:02d}")
    return lab.forecast_wide.select(
        *STATION, *[r6(physics.wind_x(*wind(em))).alias(f"wind_x_{em:02d}") for em in MEMBERS],
        *[r6(physics.wind_y(*wind(em))).alias(f"wind_y_{em:02d}") for em in MEMBERS],
    )


@check("feat_gust_factor", f"""
SELECT sid, time_ref, lt, {each_member("round(g10m_{em} / nullif(ws10m_{em}, 0), 6) AS gust_factor_{em}")} FROM v_forecast_wide""")
def _(lab):
    return lab.forecast_wide.select(
        *STATION, *[r6(physics.gust_factor(f"g10m_{em:02d}", f"ws10m_{em:02d}")).alias(f"gust_factor_{em:02d}") for em in MEMBERS]
    )


SHEARED = "ws10m_{em} * pow(mean_hub_height / 10, 0.143)"


@check("feat_alignment", f"""
SELECT windpark_nve_id, time_ref, lt, {each_member(
    f"round(sqrt(pow(avg({SHEARED} * cos(2 * pi() * wd10m_{{em}} / 360)) OVER w, 2) + pow(avg({SHEARED} * sin(2 * pi() * wd10m_{{em}} / 360)) OVER w, 2)), 6) AS wind_alignment_{{em}}")}
FROM {SITE_SQL} WINDOW w AS (PARTITION BY time_ref, windpark_nve_id ORDER BY lt ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""")
def _(lab):
    # Hub speed is the 10 m speed times a factor of the unit, so frames are averaged per station, where the rows are fewer and lie together.
    window = Window.partitionBy("sid", "time_ref").orderBy("lt")
    aligned = lab.forecast_wide.select(
        F.col("sid").alias("windpark_statnet"), "time_ref", "lt",
        *[physics.wind_alignment(f"ws10m_{em:02d}", window, f"wd10m_{em:02d}").alias(f"alignment_{em:02d}") for em in MEMBERS],
    )
    rows = aligned.join(lab.units.select("windpark_nve_id", "windpark_statnet", "mean_hub_height"), "windpark_statnet")
    names = [f"wind_alignment_{em:02d}" for em in MEMBERS]
    at_hub = rows.select(*SITE, *[physics.hub_speed(n.removeprefix("wind_")).alias(n) for n in names])
    return at_hub.withColumns({n: round_to(n, 6) for n in names})


@check("feat_season", f"SELECT time, bidding_area, {SEASON_SQL} FROM v_hourly")
def _(lab):
    return lab.hourly.drop("power").withColumns(rounded(seasons.season()))


NOWCAST_FEATURES = [
    "now_air_temperature_2m", "now_air_pressure_at_sea_level", "now_relative_humidity_2m", "now_precipitation_amount",
    "now_wind_speed_10m", "now_wind_direction_10m", "now_air_density", "location_mean_ws", "now_wind_alignment",
    "now_wind_power_density",
]


@check("feat_nowcast", "SELECT windpark_statnet, time_ref, "
       + ", ".join(f"round({c}, 6) AS {c}" for c in NOWCAST_FEATURES) + " FROM v_nowcast_feat")
def _(lab):
    features = local.nowcast_features(lab.nowcast)
    return features.select("windpark_statnet", "time_ref", *[r6(c).alias(c) for c in NOWCAST_FEATURES])


@check("feat_outage", """
SELECT windpark_nve_id, time_ref, time, round(coalesce(unavailable_capacity, 0), 6) AS unavailable_capacity
FROM v_unit_cell LEFT JOIN v_unit_share USING (windpark_nve_id, time_ref, time)""")
def _(lab):
    return local.with_outages(settle(unit_cells(lab), "cells"), lab.outages).withColumn("unavailable_capacity", r6("unavailable_capacity"))


@check("feat_transmission", """
SELECT time_ref, time, bidding_area, coalesce(unplannedEvent, false) AS unplannedEvent, round(coalesce(unavailable_transmission, 0), 6) AS unavailable_transmission
FROM v_area_cell LEFT JOIN v_area_share USING (time_ref, time, bidding_area)""")
def _(lab):
    from forecastlab.sources.messages import page_items, transmission_outages

    landed = transmission_outages(page_items(lab.pages), after="1995-06-01")
    return area.with_transmission(settle(area_cells(lab), "cells"), landed).withColumn(
        "unavailable_transmission", r6("unavailable_transmission")
    )


@check("feat_relative_power", """
SELECT time, bidding_area, operating_power_max, round(relative_power, 6) AS relative_power FROM v_relative""")
def _(lab):
    return area.relative_power(lab.area_power, lab.units).select(
        "time", "bidding_area", "operating_power_max", r6("relative_power").alias("relative_power")
    )


RECENT = ["last_power", "recent_mean", "recent_max", "recent_min", "recent_std", "ramp", "recent_range"]


@check("feat_recent_block", "SELECT bidding_area, time AS time_ref, " + ", ".join(f"round({c}, 6) AS {c}" for c in RECENT) + " FROM v_recent")
def _(lab):
    block = area.recent_block(area.relative_power(lab.area_power, lab.units))
    return block.select("bidding_area", F.col("time").alias("time_ref"), *[r6(c).alias(c) for c in RECENT])


LOCAL_SQL = f"""
WITH v_grid AS (
  SELECT * FROM v_units CROSS JOIN (SELECT DISTINCT time_ref, time FROM v_forecast_wide) WHERE time_ref > production_start_date),
v_cell AS (
  SELECT g.*, p.local_power, coalesce(s.unavailable_capacity, 0) AS unavailable_capacity, n.* EXCLUDE (windpark_statnet, time_ref)
  FROM v_grid g LEFT JOIN v_unit_power p USING (windpark_nve_id, time)
       LEFT JOIN (SELECT c.windpark_nve_id, c.time_ref, c.time, sum(o.unavailableCapacity) / sum(o.installedCapacity) AS unavailable_capacity
                  FROM v_grid c JOIN v_outage o USING (windpark_nve_id)
                  WHERE c.time_ref > o.publicationDate AND c.time >= o.eventStart AND c.time <= o.eventStop GROUP BY 1, 2, 3) s
         USING (windpark_nve_id, time_ref, time)
       LEFT JOIN v_nowcast_feat n ON n.windpark_statnet = g.windpark_statnet AND n.time_ref = g.time_ref),
v_row AS (
  SELECT c.*, f.lt, f.em, f.ws10m, f.wd10m, f.t2m, f.rh2m, f.mslp, f.g10m
  FROM v_cell c LEFT JOIN v_forecast f ON f.windpark_statnet = c.windpark_statnet AND f.time_ref = c.time_ref AND f.time = c.time),
v_dataset AS (
  SELECT *, g10m / nullif(ws10m, 0) AS gust_factor, local_power / operating_power_max AS local_relative_power,
         {", ".join(f"{sql} AS {name}" for name, sql in SEASON_RAW.items())},
         sqrt(pow(avg(wshh * cos(2 * pi() * wd10m / 360)) OVER w, 2) + pow(avg(wshh * sin(2 * pi() * wd10m / 360)) OVER w, 2)) AS wind_alignment
  FROM ({HUB_AIR.format(source='v_row')})
  WINDOW w AS (PARTITION BY time_ref, windpark_nve_id, em ORDER BY lt ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))"""

LOCAL_NUMBERS = [c for c in local.LOCAL_FEATURES if not c.startswith("ELSPOT")] + [
    "local_power", "local_relative_power", "operating_power_max", "mean_production", "num_turbines"
]


def mean(name):
    """The average, from the sum and the count that stands beside it: one partial value less per column and group."""
    return F.try_divide(F.sum(F.col(name).cast("double")), F.count(name))


def distinct_members(name):
    """How many members occur: a bit each, so that rows are not grouped by member first. Numbers beyond the bits raise an error."""
    beyond = F.raise_error(F.lit("members above 62 have no bit")).cast("long")
    bit = F.when(F.col(name).between(0, 62), F.expr(f"shiftleft(1L, {name})")).when(F.col(name).isNotNull(), beyond)
    return F.coalesce(F.bit_count(F.bit_or(bit)), F.lit(0)).cast("long")


@check("feat_local_dataset", LOCAL_SQL + """
SELECT date_trunc('month', time_ref)::TIMESTAMP AS month, windpark_nve AS windpark, count(*) AS n, count(DISTINCT em) AS n_members, """
       + ", ".join(f"round(1e-8 + avg({c}), 4) AS {c}, count({c}) AS n_{c}" for c in LOCAL_NUMBERS)
       + ", " + ", ".join(f"bool_or(bidding_area = 'ELSPOT NO{k}') AS is_no{k}" for k in range(1, 5))
       + " FROM v_dataset GROUP BY 1, 2")
def _(lab):
    # One row per unit, valid time and member; compared by unit and month: mean (shifted off the edge of
    # rounding) and count of every column.
    table = lab.local_table
    return table.groupBy(F.date_trunc("MONTH", "time_ref").alias("month"), "windpark").agg(
        F.count(F.lit(1)).alias("n"), distinct_members("em").alias("n_members"),
        *[F.round(OFF_EDGE + mean(c), 4).alias(c) for c in LOCAL_NUMBERS],
        *[F.count(c).alias(f"n_{c}") for c in LOCAL_NUMBERS],
        *[F.bool_or(f"`ELSPOT NO{k}`").alias(f"is_no{k}") for k in range(1, 5)],
    )


@check("feat_local_issue", LOCAL_SQL + """
SELECT time_ref, windpark_nve AS windpark, count(*) AS n, """
       + ", ".join(f"round(1e-8 + avg({c}), 3) AS {c}, count({c}) AS n_{c}" for c in LOCAL_NUMBERS)
       + " FROM v_dataset GROUP BY 1, 2")
def _(lab):
    # The same table by issue and unit: the few valid times and members of one forecast.
    table = lab.local_table
    return table.groupBy("time_ref", "windpark").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.round(OFF_EDGE + mean(c), 3).alias(c) for c in LOCAL_NUMBERS],
        *[F.count(c).alias(f"n_{c}") for c in LOCAL_NUMBERS],
    )


AREA_NUMBERS = [
    c for c in [*area.KEYS, *area.AREA_FEATURES, *area.EMOS_FEATURES]
    if c not in ("time_ref", "time", "bidding_area", "lt", "num_turbines", "unplannedEvent")
]


def area_table(lab, compat=False):
    return area.area_dataset(lab.local_pred_wide, lab.area_power, lab.units, lab.transmission, compat)


@check("feat_area_dataset", "SELECT time_ref, time, bidding_area, lt, num_turbines, unplannedEvent, "
       + ", ".join(f"round({c}, 6) AS {c}" for c in AREA_NUMBERS) + " FROM v_area_dataset")
def _(lab):
    return area_table(lab).select(
        "time_ref", "time", "bidding_area", "lt", "num_turbines", "unplannedEvent", *[r6(F.col(c).cast("double")).alias(c) for c in AREA_NUMBERS]
    )


@check("feat_emos_mean_design", "SELECT time_ref, time, bidding_area, CAST(1 AS DOUBLE) AS intercept, "
       + ", ".join(f"round({c}, 6) AS {c}" for c in design.WIDER_MEAN_COLUMNS) + " FROM v_area_dataset")
def _(lab):
    columns = design.mean_design(design.WIDER_MEAN_COLUMNS)
    return area_table(lab).select("time_ref", "time", "bidding_area", *[r6(c).alias(n) for n, c in columns.items()])


@check("feat_emos_spread_design", """
SELECT time_ref, time, bidding_area, CAST(1 AS DOUBLE) AS intercept, round(ln(greatest(std_sum_pred, 1e-6)), 5) AS log_std_sum_pred,
       round((lt - 39) / 23, 5) AS lt, round(mean_sum_pred, 5) AS mean_sum_pred,
       round(ln(greatest(max_sum_pred - min_sum_pred, 1e-6)), 5) AS log_range_pred,
       round(CASE WHEN recent_std IS NOT NULL THEN ln(greatest(recent_std, 1e-6)) END, 5) AS log_recent_std,
       round(CASE WHEN ramp IS NOT NULL THEN ln(greatest(abs(ramp), 1e-6)) END, 5) AS log_ramp, round(unavailable_transmission, 5) AS unavailable_transmission
FROM v_area_dataset""")
def _(lab):
    return area_table(lab).select(
        "time_ref", "time", "bidding_area", *[F.round(c, 5).alias(n) for n, c in design.spread_design().items()]
    )


def enriched(lab):
    sites = units.unit_sites(geo_sites(lab), lab.lookup)
    geo = units.site_features(sites, lab.raster, lab.raster)
    return units.enriched_units(lab.lookup, register_columns(lab.register), geo, lab.unit_power)


SAMPLED_SQL = """
SELECT windpark_nve_id, CASE WHEN count(value) = count(*) THEN sum(value * weight) END AS value FROM (
  SELECT p.windpark_nve_id, c.value, p.weight FROM (
    SELECT windpark_nve_id, floor(x) + dx AS ix, floor(y) + dy AS iy,
           (CASE dx WHEN 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) * (CASE dy WHEN 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) AS weight
    FROM {points}, generate_series(0, 1) AS g(dx), generate_series(0, 1) AS h(dy)) p
  LEFT JOIN v_raster c ON c.ix = p.ix AND c.iy = p.iy WHERE weight > 0) GROUP BY 1"""

SHIFTED = "(SELECT windpark_nve_id, CASE WHEN windpark_nve_id % 3 = 0 THEN x + 1 ELSE x END AS x, y FROM v_points)"


@check("feat_raster_bilinear", f"SELECT windpark_nve_id, round(value, 6) AS value FROM ({SAMPLED_SQL.format(points='v_points')})")
def _(lab):
    return bilinear(lab.points, lab.raster, "windpark_nve_id").withColumn("value", r6("value"))


@check("feat_unit_enrich", f"""
SELECT r.windpark_nve_id, r.windpark_nve, r.windpark_statnet, r.bidding_area, r.bidding_area AS province, r.windpark_statnet AS county,
       r.production_start_date, r.operating_power_max AS reported_operating_power_max,
       greatest(r.operating_power_max, coalesce(m.top, 0)) AS operating_power_max,
       round(coalesce(r.hub, (SELECT avg(hub) FROM v_register)), 6) AS mean_hub_height, r.mean_production, r.mean_rotor_diameter,
       r.num_turbines, round(s.value, 6) AS elevation, round(coalesce(s.value, 0), 6) AS ruggedness
FROM v_register r LEFT JOIN ({SAMPLED_SQL.format(points=SHIFTED)}) s USING (windpark_nve_id)
     LEFT JOIN (SELECT windpark_nve_id, max(local_power) AS top FROM v_unit_power GROUP BY 1) m USING (windpark_nve_id)""")
def _(lab):
    return enriched(lab).withColumns({c: r6(c) for c in ("mean_hub_height", "elevation", "ruggedness")})


ENSEMBLE = [f"{v}_{em:02d}" for v in WEATHER_VARIABLES for em in MEMBERS]


@check("feat_standardize", "SELECT sid, time_ref, lt, " + ", ".join(f"round(({c} - m.a_{c}) / nullif(m.b_{c}, 0), 5) AS {c}" for c in ENSEMBLE)
       + " FROM v_forecast_wide, (SELECT " + ", ".join(f"avg({c}) AS a_{c}, stddev_samp({c}) AS b_{c}" for c in ENSEMBLE)
       + " FROM v_forecast_wide WHERE time_ref < TIMESTAMP '1999-01-01 00:00:00') m")
def _(lab):
    rows = lab.forecast_wide.select("sid", "time_ref", "lt", *ENSEMBLE)
    train = rows.filter(F.col("time_ref") < F.lit("1999-01-01").cast("timestamp"))
    return design.standardize(rows, train, ENSEMBLE).withColumns({c: F.round(c, 5) for c in ENSEMBLE})
