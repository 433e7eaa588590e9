"""Projections, filters and scalar functions (survey 2.2, 2.6, 2.8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from forecastlab.catalog.registry import check
from forecastlab.functions import ensemble, scalars, seasons
from forecastlab.plans.local import nowcast_columns
from forecastlab.plans.report import describe, missing_profile, sample_keys
from forecastlab.plans.units import observed_capacity

WS = [f"ws10m_{em:02d}" for em in range(15)]
WS_LIST = "[" + ", ".join(WS) + "]"
SEASON_RAW = {
    "sin_hod": "sin(2 * pi() * (hour(time) / 24.0))",
    "cos_hod": "cos(2 * pi() * (hour(time) / 24.0))",
    "sin_doy": "sin(2 * pi() * ((dayofyear(time) - 1 + hour(time) / 24.0) / 365.2425))",
    "cos_doy": "cos(2 * pi() * ((dayofyear(time) - 1 + hour(time) / 24.0) / 365.2425))",
}
SEASON_SQL = ", ".join(f"round({sql}, 6) AS {name}" for name, sql in SEASON_RAW.items())


def r6(column, digits: int = 6):
    return F.round(column, digits)


def rounded(columns: dict, digits: int = 6) -> dict:
    return {name: F.round(column, digits) for name, column in columns.items()}


@check("proj_rename", 'SELECT __index_level_0__ AS time, "ELSPOT NO1" AS no1, "ELSPOT NO2" AS no2 FROM v_hourly_wide')
def _(lab):
    return lab.hourly_wide.withColumnsRenamed(
        {"__index_level_0__": "time", "ELSPOT NO1": "no1", "ELSPOT NO2": "no2"}
    ).select("time", "no1", "no2")


@check("proj_exclude_prefix", """
SELECT windpark AS windpark_statnet, time AS time_ref, air_temperature_2m AS now_air_temperature_2m,
       air_pressure_at_sea_level AS now_air_pressure_at_sea_level, relative_humidity_2m AS now_relative_humidity_2m,
       precipitation_amount AS now_precipitation_amount, wind_speed_10m AS now_wind_speed_10m,
       wind_direction_10m AS now_wind_direction_10m
FROM v_nowcast""")
def _(lab):
    return nowcast_columns(lab.nowcast)


@check("proj_drop", "SELECT windpark_nve_id, bidding_area, operating_power_max FROM v_units")
def _(lab):
    return lab.units.drop(
        "windpark_nve", "windpark_statnet", "production_start_date", "mean_production", "mean_hub_height",
        "mean_rotor_diameter", "num_turbines", "elevation", "ruggedness",
    )


@check("proj_expr_bundle", f"""
SELECT time, bidding_area, {SEASON_SQL}, bidding_area = 'ELSPOT NO1' AS "ELSPOT NO1", bidding_area = 'ELSPOT NO2' AS "ELSPOT NO2",
       bidding_area = 'ELSPOT NO3' AS "ELSPOT NO3", bidding_area = 'ELSPOT NO4' AS "ELSPOT NO4"
FROM v_area_power""")
def _(lab):
    added = lab.area_power.drop("power").withColumns({**rounded(seasons.season()), **seasons.area_dummies()})
    return added


@check("proj_pipe", """
SELECT time, bidding_area, round(power / 10, 6) AS power, 'scaled' AS step FROM v_area_power WHERE power > 5""")
def _(lab):
    def large(df: DataFrame) -> DataFrame:
        return df.filter(F.col("power") > 5)

    def scaled(df: DataFrame, by: float) -> DataFrame:
        return df.withColumn("power", r6(F.col("power") / by))

    return lab.area_power.transform(large).transform(scaled, by=10).withColumn("step", F.lit("scaled"))


@check("proj_literal", "SELECT sid, time_ref, lt, 1 AS intercept, 'forecast' AS source FROM v_forecast_wide")
def _(lab):
    return lab.forecast_wide.select("sid", "time_ref", "lt", F.lit(1).alias("intercept"), F.lit("forecast").alias("source"))


@check("proj_one_hot", """
SELECT windpark_nve_id, """ + ", ".join(f"bidding_area = 'ELSPOT NO{k}' AS \"ELSPOT NO{k}\"" for k in range(1, 5)) + " FROM v_units")
def _(lab):
    return lab.units.select("windpark_nve_id", *[c.alias(n) for n, c in seasons.area_dummies().items()])


@check("proj_case_when", """
SELECT messageId, CASE WHEN unplannedEvent THEN 'unplanned' ELSE 'planned' END AS label FROM v_transmission""")
def _(lab):
    return lab.transmission.select(
        "messageId", F.when(F.col("unplannedEvent"), "unplanned").otherwise("planned").alias("label")
    )


@check("proj_coalesce", """
SELECT windpark_nve_id, round(coalesce(CASE WHEN windpark_nve_id % 11 <> 0 THEN num_turbines END,
       operating_power_max / (SELECT avg(operating_power_max / num_turbines) FROM v_units WHERE windpark_nve_id % 11 <> 0)), 6) AS num_turbines
FROM v_units""")
def _(lab):
    known = lab.units.withColumn("num_turbines", F.when(F.col("windpark_nve_id") % 11 != 0, F.col("num_turbines")))
    mw_per_turbine = known.agg(F.avg(scalars.ratio("operating_power_max", "num_turbines"))).scalar()
    turbines = F.coalesce(F.col("num_turbines").cast("double"), F.col("operating_power_max") / mw_per_turbine)
    return known.select("windpark_nve_id", r6(turbines).alias("num_turbines"))


@check("proj_greatest", """
SELECT u.windpark_nve_id, u.operating_power_max AS reported_operating_power_max,
       greatest(u.operating_power_max, coalesce(m.top, u.operating_power_max)) AS operating_power_max
FROM v_units u LEFT JOIN (SELECT windpark_nve_id, max(local_power) AS top FROM v_unit_power GROUP BY 1) m USING (windpark_nve_id)""")
def _(lab):
    return observed_capacity(lab.units, lab.unit_power).select(
        "windpark_nve_id", "reported_operating_power_max", "operating_power_max"
    )


@check("proj_row_mean", f"SELECT sid, time_ref, lt, round(list_avg({WS_LIST}), 6) AS ws10m_mean FROM v_forecast_wide")
def _(lab):
    mean = ensemble.array_mean(ensemble.members(WS))
    return lab.forecast_wide.select("sid", "time_ref", "lt", r6(mean).alias("ws10m_mean"))


@check("proj_row_std_median", f"""
SELECT sid, time_ref, lt, round(list_stddev_samp({WS_LIST}), 6) AS ws10m_std, round(list_median({WS_LIST}), 6) AS ws10m_median
FROM v_forecast_wide""")
def _(lab):
    # The members become a column first: the lambdas below read it at every element.
    rows, values = lab.forecast_wide.select("sid", "time_ref", "lt", ensemble.members(WS).alias("_ws")), F.col("_ws")
    return rows.select(
        "sid", "time_ref", "lt", r6(ensemble.array_std(values)).alias("ws10m_std"),
        r6(ensemble.array_median(values)).alias("ws10m_median"),
    )


@check("proj_value_map", """
SELECT windpark_nve_id, CASE bidding_area WHEN 'ELSPOT NO1' THEN 'East' WHEN 'ELSPOT NO3' THEN 'Mid' ELSE bidding_area END AS bidding_area
FROM v_units""")
def _(lab):
    named = lab.units.replace({"ELSPOT NO1": "East", "ELSPOT NO3": "Mid"}, subset=["bidding_area"])
    return named.select("windpark_nve_id", "bidding_area")


@check("flt_conjunction", """
SELECT sid, time_ref, lt FROM v_forecast_wide
WHERE lt > 20 AND ws10m_00 > 3 AND time_ref >= TIMESTAMP '1998-01-01 00:00:00'""")
def _(lab):
    return lab.forecast_wide.filter(
        (F.col("lt") > 20) & (F.col("ws10m_00") > 3) & (F.col("time_ref") >= F.lit("1998-01-01").cast("timestamp"))
    ).select("sid", "time_ref", "lt")


@check("flt_null", "SELECT o_orderkey AS k, 'M' || o_orderkey AS messageId FROM v_message WHERE messageType = 1 AND generation")
def _(lab):
    return lab.messages.filter(
        F.col("productionUnits").isNull() & F.col("generationUnits").isNotNull()
    ).select(F.substring("messageId", 2, 20).cast("long").alias("k"), "messageId")


@check("flt_not_nan", """
SELECT time, bidding_area, round(power, 6) AS y FROM v_area_power WHERE hour(time) <> 6""")
def _(lab):
    y = F.when(F.hour("time") == 6, F.lit(float("nan"))).otherwise(F.col("power"))
    return lab.area_power.select("time", "bidding_area", r6(y).alias("y")).filter(~F.isnan("y"))


@check("flt_is_in", "SELECT windpark_nve_id, bidding_area FROM v_units WHERE bidding_area IN ('ELSPOT NO2', 'ELSPOT NO3')")
def _(lab):
    return lab.units.filter(F.col("bidding_area").isin("ELSPOT NO2", "ELSPOT NO3")).select("windpark_nve_id", "bidding_area")


@check("flt_lead_slice", """
SELECT sid, time_ref, lt, CASE WHEN lt <= 27 THEN 'short' ELSE 'long' END AS part FROM v_forecast_wide WHERE lt <= 27 OR lt > 45""")
def _(lab):
    short = lab.forecast_wide.filter(F.col("lt") <= 27).withColumn("part", F.lit("short"))
    long = lab.forecast_wide.filter(F.col("lt") > 45).withColumn("part", F.lit("long"))
    return short.unionByName(long).select("sid", "time_ref", "lt", "part")


@check("flt_any_of", """
SELECT messageId, eic FROM v_production_outage WHERE eic IS NULL OR eic = 'EIC3' OR installedCapacity > 90""")
def _(lab):
    from forecastlab.sources.messages import production_outages

    return production_outages(lab.messages).filter(
        F.col("eic").isNull() | (F.col("eic") == "EIC3") | (F.col("installedCapacity") > 90)
    ).select("messageId", "eic")


@check("flt_day_ahead", """
SELECT sid, time_ref, time, 'date' AS form FROM v_forecast_wide WHERE CAST(time AS DATE) = CAST(time_ref + INTERVAL '2' DAY AS DATE)
UNION ALL
SELECT sid, time_ref, time, 'half_open' FROM v_forecast_wide
WHERE time >= CAST(time_ref AS DATE) + INTERVAL '1' DAY AND time < CAST(time_ref AS DATE) + INTERVAL '2' DAY""")
def _(lab):
    rows = lab.forecast_wide.select("sid", "time_ref", "time")
    day = F.date_trunc("DAY", "time_ref")
    half_open = (F.col("time") >= scalars.add_days(day, 1)) & (F.col("time") < scalars.add_days(day, 2))
    return rows.filter(scalars.is_day_ahead("time", "time_ref")).withColumn("form", F.lit("date")).unionByName(
        rows.filter(half_open).withColumn("form", F.lit("half_open"))
    )


@check("flt_after_start", """
SELECT windpark_nve_id, time_ref, lt FROM v_forecast_wide JOIN v_units ON sid = windpark_statnet
WHERE time_ref > production_start_date""")
def _(lab):
    return (
        lab.forecast_wide.join(lab.units, F.col("sid") == F.col("windpark_statnet"))
        .filter(F.col("time_ref") > F.col("production_start_date"))
        .select("windpark_nve_id", "time_ref", "lt")
    )


@check("null_fill_const", """
SELECT u.windpark_nve_id, u.windpark_nve, coalesce(p.n, 0) AS n
FROM v_units u LEFT JOIN (SELECT windpark_nve_id, count(*) AS n FROM v_outage GROUP BY 1) p USING (windpark_nve_id)""")
def _(lab):
    counted = lab.outages.groupBy("windpark_nve_id").agg(F.count(F.lit(1)).alias("n"))
    return lab.units.join(counted, "windpark_nve_id", "left").fillna(0, ["n"]).select("windpark_nve_id", "windpark_nve", "n")


@check("null_fill_mean", """
SELECT windpark_nve_id, round(coalesce(hub, (SELECT avg(hub) FROM v_register)), 6) AS mean_hub_height FROM v_register""")
def _(lab):
    mean = lab.register.agg(F.avg("GjsnittNavhoeyde")).scalar()
    return lab.register.select(
        F.col("VindkraftAnleggId").alias("windpark_nve_id"), r6(F.coalesce("GjsnittNavhoeyde", mean)).alias("mean_hub_height")
    )


@check("null_drop", """
SELECT __index_level_0__ AS time FROM v_hourly_wide
WHERE """ + " AND ".join(f'"ELSPOT NO{k}" IS NOT NULL' for k in range(1, 6)))
def _(lab):
    return lab.hourly_wide.dropna("any").select(F.col("__index_level_0__").alias("time"))


@check("null_profile", " UNION ALL ".join(
    f"SELECT 'ELSPOT NO{k}' AS feature, count(*) AS n, count(*) - count(\"ELSPOT NO{k}\") AS missing, min(\"ELSPOT NO{k}\") AS low, max(\"ELSPOT NO{k}\") AS high FROM v_hourly_wide"
    for k in range(1, 6)))
def _(lab):
    return missing_profile(lab.hourly_wide, [f"ELSPOT NO{k}" for k in range(1, 6)])


NOWCAST = [
    "air_temperature_2m", "air_pressure_at_sea_level", "relative_humidity_2m", "precipitation_amount", "wind_speed_10m", "wind_direction_10m",
]


@check("tbl_describe", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count({c}) AS n, count(*) - count({c}) AS missing, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS low, max({c}) AS high FROM v_nowcast"
    for c in NOWCAST))
def _(lab):
    summary = describe(lab.nowcast, NOWCAST)
    return summary.withColumns({c: r6(F.col(c)) for c in ("mean", "std")})


@check("tbl_sample", """
SELECT time_ref, sid FROM (SELECT DISTINCT time_ref, sid FROM v_forecast_wide)
ORDER BY md5(strftime(time_ref, '%Y-%m-%d %H:%M:%S') || '|' || sid) LIMIT 5""")
def _(lab):
    return sample_keys(lab.forecast_wide, ["time_ref", "sid"], 5)


@check("sort_multi", """
SELECT time_ref, time, sid, row_number() OVER (ORDER BY time_ref, time, sid) - 1 AS pos FROM v_forecast_wide""")
def _(lab):
    from forecastlab.operators.series import global_position

    order = ["time_ref", "time", "sid"]
    return global_position(lab.forecast_wide.select(*order), order).orderBy(*order)


@check("topk_tail", """
SELECT 'worst' AS part, bidding_area, time, round(power, 6) AS power FROM
  (SELECT * FROM v_area_power ORDER BY power DESC, time, bidding_area LIMIT 100)
UNION ALL
SELECT 'last', bidding_area, time, round(power, 6) FROM
  (SELECT *, row_number() OVER (PARTITION BY bidding_area ORDER BY time DESC) AS rn FROM v_area_power) WHERE rn <= 200""")
def _(lab):
    from forecastlab.operators.ranks import top_per_key

    worst = lab.area_power.orderBy(F.desc("power"), "time", "bidding_area").limit(100)
    last = top_per_key(lab.area_power, ["bidding_area"], [F.desc("time")], 200)
    return worst.withColumn("part", F.lit("worst")).unionByName(last.withColumn("part", F.lit("last"))).select(
        "part", "bidding_area", "time", r6("power").alias("power")
    )


@check("fn_math", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(exp(l_discount), 6) AS e, round(ln(l_quantity), 6) AS l,
       round(sqrt(l_quantity), 6) AS s, round(pow(l_quantity, 0.143), 6) AS p, abs(l_discount - l_tax) < 0.0000001 AS a,
       round(sin(l_quantity), 6) AS si, round(cos(l_quantity), 6) AS co
FROM lineitem""")
def _(lab):
    x = F.col("l_quantity")
    return lab.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6(F.exp("l_discount")).alias("e"), r6(F.ln(x)).alias("l"),
        r6(F.sqrt(x)).alias("s"), r6(F.pow(x, F.lit(0.143))).alias("p"),
        (F.abs(F.col("l_discount") - F.col("l_tax")) < 1e-7).alias("a"), r6(F.sin(x)).alias("si"), r6(F.cos(x)).alias("co"),
    )


@check("fn_clip", """
SELECT sid, time_ref, lt, CASE WHEN lt <> 15 THEN least(greatest(ws10m_14, 2), 20) END AS both,
       CASE WHEN lt <> 15 THEN greatest(ws10m_14, 2) END AS low
FROM v_forecast_wide""")
def _(lab):
    speed = F.when(F.col("lt") != 15, F.col("ws10m_14"))
    return lab.forecast_wide.select(
        "sid", "time_ref", "lt", scalars.clip(speed, 2, 20).alias("both"), scalars.clip(speed, low=2).alias("low")
    )


@check("fn_string", """
SELECT windpark_nve_id, replace(windpark_nve, '#', ' ') AS replaced, right(bidding_area, 3) AS tail, lower(windpark_nve) AS lowered,
       CAST(right(bidding_area, 1) AS BIGINT) AS area_no
FROM v_units""")
def _(lab):
    return lab.units.select(
        "windpark_nve_id", F.replace("windpark_nve", F.lit("#"), F.lit(" ")).alias("replaced"),
        scalars.last_chars("bidding_area", 3).alias("tail"), F.lower("windpark_nve").alias("lowered"),
        scalars.last_chars("bidding_area", 1).cast("long").alias("area_no"),
    )


@check("fn_parse_time_offset", """
SELECT o_orderkey, o_orderdate + CAST(o_orderkey % 24 AS INT) * INTERVAL '1' HOUR - INTERVAL '1' HOUR AS utc FROM orders""")
def _(lab):
    local = F.date_format(scalars.add_hours("o_orderdate", F.col("o_orderkey") % 24), "yyyy-MM-dd HH:mm:ss")
    return lab.table("orders").select("o_orderkey", scalars.offset_to_utc(local, 1).alias("utc"))


@check("fn_time_parts", """
SELECT event_id, hour(ts) AS h, CAST(ts AS DATE) AS d, year(ts) AS y, dayofyear(ts) AS doy, strftime(ts, '%Y-%m') AS m FROM events""")
def _(lab):
    return lab.table("events").select(
        "event_id", F.hour("ts").alias("h"), F.to_date("ts").alias("d"), F.year("ts").alias("y"),
        F.dayofyear("ts").alias("doy"), F.date_format("ts", "yyyy-MM").alias("m"),
    )


@check("fn_lead_hours", """
SELECT event_id, CAST(trunc(epoch_us(ts - (TIMESTAMP '2024-01-15 09:00:00')) / 3600000000) AS BIGINT) AS lt FROM events""")
def _(lab):
    issued = F.lit("2024-01-15 09:00:00").cast("timestamp")
    return lab.table("events").select("event_id", scalars.lead_hours(F.col("ts"), issued).alias("lt"))


@check("fn_time_shift", """
SELECT sid, lt, time_ref + INTERVAL '2' DAY AS d2, time_ref + CAST(lt AS INT) * INTERVAL '1' HOUR AS valid, time_ref + INTERVAL '2160' HOUR AS late
FROM v_forecast_wide""")
def _(lab):
    return lab.forecast_wide.select(
        "sid", "lt", scalars.add_days("time_ref", 2).alias("d2"), scalars.add_hours("time_ref", "lt").alias("valid"),
        scalars.add_hours("time_ref", 90 * 24).alias("late"),
    )


@check("fn_cast", """
SELECT event_id, try_cast(replace(props, '{"k": ', '') AS INT) AS broken, CAST(CAST(event_id % 2 = 0 AS INT) AS FLOAT) AS flag,
       try_cast(event_type AS TIMESTAMP) AS no_time, CAST(value AS FLOAT) > 10 AS large
FROM events""")
def _(lab):
    return lab.table("events").select(
        "event_id", F.replace("props", F.lit('{"k": '), F.lit("")).try_cast("int").alias("broken"),
        (F.col("event_id") % 2 == 0).cast("int").cast("float").alias("flag"),
        F.col("event_type").try_cast("timestamp").alias("no_time"), (F.col("value").cast("float") > 10).alias("large"),
    )


@check("fn_struct_field", """
SELECT messageId, 'NO' || (o_custkey % 6 + 1) AS outAreaName, 'NO' || ((o_custkey + 1) % 6 + 1) AS inAreaName,
       CAST(50 + o_custkey % 50 AS DOUBLE) AS installedCapacity
FROM v_message WHERE messageType = 3""")
def _(lab):
    fields = ["outAreaName", "inAreaName", "installedCapacity"]
    line = lab.messages.filter(F.col("messageType") == 3).select("messageId", F.col("transmissionUnits")[0].alias("line"))
    return line.select("messageId", *[F.col(f"line.{f}") for f in fields])


@check("fn_flag_from_code", "SELECT messageId, unavailabilityType = 1 AS unplannedEvent FROM v_message")
def _(lab):
    return lab.messages.select("messageId", (F.col("unavailabilityType") == 1).alias("unplannedEvent"))
