"""Set operations and reshapes (survey 2.7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from forecastlab.catalog.joins import MARKET_SQL
from forecastlab.catalog.registry import check
from forecastlab.catalog.rows import r6
from forecastlab.operators import reshape, series
from forecastlab.sources import messages
from forecastlab.sources.schemas import MEMBERS, WEATHER_VARIABLES


@check("set_union_all", """
SELECT time, bidding_area, round(power, 6) AS power FROM v_area_power UNION ALL SELECT time, bidding_area, round(power, 6) FROM v_hourly""")
def _(lab):
    return lab.area_power.unionByName(lab.hourly).select("time", "bidding_area", r6("power").alias("power"))


@check("set_union_labelled", """
SELECT time, bidding_area, round(power, 6) AS power, 'area' AS source FROM v_area_power
UNION ALL SELECT time, bidding_area, round(local_power, 6), 'units' FROM v_local_sum""")
def _(lab):
    summed = lab.unit_power.join(lab.units.select("windpark_nve_id", "bidding_area"), "windpark_nve_id").groupBy(
        "time", "bidding_area"
    ).agg(F.sum("local_power").alias("power"))
    both = lab.area_power.withColumn("source", F.lit("area")).unionByName(summed.withColumn("source", F.lit("units")))
    return both.select("time", "bidding_area", r6("power").alias("power"), "source")


@check("set_union_distinct", """
SELECT windpark_nve AS name FROM v_lookup UNION SELECT windpark_statnet FROM v_lookup UNION SELECT windpark_nve FROM v_lookup""")
def _(lab):
    a, b = lab.lookup.select(F.col("windpark_nve").alias("name")), lab.lookup.select(F.col("windpark_statnet").alias("name"))
    return a.unionByName(b).unionByName(a).distinct()


@check("rs_unpivot", """
SELECT __index_level_0__ AS time, bidding_area, power FROM v_hourly_wide
UNPIVOT INCLUDE NULLS (power FOR bidding_area IN ("ELSPOT NO1", "ELSPOT NO2", "ELSPOT NO3", "ELSPOT NO4", "ELSPOT NO5"))""")
def _(lab):
    return reshape.series_long(lab.hourly_wide.withColumnRenamed("__index_level_0__", "time"), "time", "power")


@check("rs_unpivot_subset", """
SELECT sid, time_ref, lt, variable, value FROM (SELECT sid, time_ref, lt, ws10m_00, t2m_00 FROM v_forecast_wide)
UNPIVOT INCLUDE NULLS (value FOR variable IN (ws10m_00, t2m_00))""")
def _(lab):
    return lab.forecast_wide.unpivot(["sid", "time_ref", "lt"], ["ws10m_00", "t2m_00"], "variable", "value")


@check("rs_ensemble_long", " UNION ALL ".join(
    f"SELECT sid AS windpark_statnet, time_ref, time, lt, CAST({em} AS INT) AS em, "
    + ", ".join(f"{v}_{em:02d} AS {v}" for v in WEATHER_VARIABLES) + " FROM v_forecast_wide" for em in MEMBERS))
def _(lab):
    return lab.forecast


@check("rs_explode", """
SELECT messageId, 'EIC' || (o_custkey // 15 + u) AS eic, j
FROM v_message, generate_series(0, 1) AS g(u), generate_series(0, 1) AS h(j)
WHERE messageType = 1 AND NOT generation AND u <= o_orderkey % 2 AND j <= (o_orderkey // 2) % 2""")
def _(lab):
    units = lab.messages.select("messageId", F.explode("productionUnits").alias("unit"))
    return units.select("messageId", F.col("unit.eic").alias("eic"), F.posexplode("unit.timePeriods").alias("j", "p")).select(
        "messageId", "eic", F.col("j").cast("long").alias("j")
    )


PERIOD = "installedCapacity, unavailableCapacity, availableCapacity, eventStart, eventStop"


@check("rs_unnest_messages_production", f"SELECT messageId, unplannedEvent, publicationDate, eic, {PERIOD} FROM v_production_outage")
def _(lab):
    return messages.production_outages(lab.messages)


@check("rs_unnest_messages_transmission", f"""
SELECT messageId, unplannedEvent, publicationDate, outAreaName, inAreaName, {PERIOD} FROM v_transmission""")
def _(lab):
    return messages.transmission_outages(lab.messages, after="1995-06-01")


@check("rs_unnest_messages_market", f"""
SELECT messageId, areaName, name, eic, publicationDate, eventStart, eventStop
FROM ({MARKET_SQL}) JOIN (SELECT messageId, publicationDate, first_day AS eventStart, first_day + INTERVAL '24' HOUR AS eventStop FROM v_message) USING (messageId)""")
def _(lab):
    return messages.market_information(lab.messages).select(
        "messageId", "areaName", "name", "eic", "publicationDate", "eventStart", "eventStop"
    )


@check("rs_first_of_lists", """
SELECT m.messageId, CASE WHEN m.messageType = 1 THEN 'EIC' || (m.o_custkey // 15) END AS eic,
       CASE WHEN m.messageType = 1 THEN p.installedCapacity END AS installedCapacity,
       p.unavailableCapacity, p.eventStart, p.eventStop
FROM v_message m LEFT JOIN v_period p ON m.messageId = p.messageId AND m.messageType = 1""")
def _(lab):
    return messages.first_unit_outages(lab.messages).select(
        "messageId", "eic", "installedCapacity", "unavailableCapacity", "eventStart", "eventStop"
    )


@check("rs_date_spine", """
SELECT windpark_nve_id, time, last_value(local_power IGNORE NULLS) OVER (PARTITION BY windpark_nve_id ORDER BY time
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS local_power
FROM (SELECT windpark_nve_id, unnest(generate_series(min(time), max(time), INTERVAL '1' DAY)) AS time FROM
        (SELECT windpark_nve_id, date_trunc('day', time) AS time FROM v_unit_power) GROUP BY 1)
LEFT JOIN (SELECT windpark_nve_id, date_trunc('day', time) AS time, sum(local_power) AS local_power FROM v_unit_power GROUP BY 1, 2)
USING (windpark_nve_id, time)""")
def _(lab):
    daily = lab.unit_power.groupBy("windpark_nve_id", F.date_trunc("DAY", "time").alias("time")).agg(
        F.sum("local_power").alias("local_power")
    )
    return series.fill_gaps(daily, ["windpark_nve_id"], "time", ["local_power"], "1 day")


ARRAYS_SQL = """
SELECT i.bidding_area, i.time AS time_ref,
       list(p.power ORDER BY p.time) FILTER (WHERE p.time <= i.time) AS lookback,
       list(p.power ORDER BY p.time) FILTER (WHERE p.time >= i.time + INTERVAL '39' HOUR) AS target
FROM v_spine i JOIN v_spine p ON i.bidding_area = p.bidding_area AND p.time BETWEEN i.time - INTERVAL '47' HOUR AND i.time + INTERVAL '62' HOUR
WHERE hour(i.time) = 9 GROUP BY 1, 2
HAVING count(*) FILTER (WHERE p.time <= i.time) = 48 AND count(*) FILTER (WHERE p.time >= i.time + INTERVAL '39' HOUR) = 24"""

SPINE_SQL = """
WITH v_spine AS (
SELECT bidding_area, time, last_value(power IGNORE NULLS) OVER (PARTITION BY bidding_area ORDER BY time
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS power
FROM (SELECT bidding_area, unnest(generate_series(min(time), max(time), INTERVAL '1' HOUR)) AS time FROM v_hourly GROUP BY 1)
LEFT JOIN v_hourly USING (bidding_area, time))"""


def issue_windows(lab):
    regular = series.fill_gaps(lab.hourly, ["bidding_area"], "time", ["power"])
    return series.issue_arrays(regular, ["bidding_area"], "time", "power", lookback=48, lead=39, window=24)


@check("rs_sliding_arrays", f"""{SPINE_SQL}
SELECT bidding_area, time_ref, array_to_string(lookback, ',') AS lookback, array_to_string(target, ',') AS target FROM (
SELECT bidding_area, time_ref, list_transform(lookback, lambda x: CAST(CAST(round(x * 100) AS BIGINT) AS VARCHAR)) AS lookback,
       list_transform(target, lambda x: CAST(CAST(round(x * 100) AS BIGINT) AS VARCHAR)) AS target FROM ({ARRAYS_SQL}))""")
def _(lab):
    def text(column: str):
        return F.array_join(F.transform(column, lambda x: F.round(x * 100).cast("long").cast("string")), ",").alias(column)

    return issue_windows(lab).select("bidding_area", "time_ref", text("lookback"), text("target"))


@check("rs_array_to_rows", f"""{SPINE_SQL}
SELECT i.bidding_area, i.time_ref, CAST(date_diff('hour', i.time_ref, p.time) AS BIGINT) AS lt, p.time, round(p.power, 6) AS y_true
FROM ({ARRAYS_SQL}) i JOIN v_spine p ON i.bidding_area = p.bidding_area
     AND p.time BETWEEN i.time_ref + INTERVAL '39' HOUR AND i.time_ref + INTERVAL '62' HOUR""")
def _(lab):
    rows = reshape.array_rows(issue_windows(lab), ["bidding_area", "time_ref"], "target", 39, "y_true")
    return rows.withColumn("y_true", r6("y_true"))


@check("rs_struct_list_build", f"""
SELECT sid, time_ref, lt, len(v) AS n, v[1] AS first, v[15] AS last, round(list_sum(v), 6) AS total
FROM (SELECT sid, time_ref, lt, [{", ".join(f"ws10m_{em:02d}" for em in MEMBERS)}] AS v FROM v_forecast_wide)""")
def _(lab):
    values = F.array(*[f"ws10m_{em:02d}" for em in MEMBERS])
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return lab.forecast_wide.select(
        "sid", "time_ref", "lt", F.size(values).cast("long").alias("n"), values[0].alias("first"), values[14].alias("last"),
        F.round(total, 6).alias("total"),
    )
