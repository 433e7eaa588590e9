"""Joins (survey 2.3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from forecastlab.catalog.registry import check
from forecastlab.catalog.rows import r6
from forecastlab.functions.scalars import last_chars
from forecastlab.operators import matching
from forecastlab.operators.capacity import active_capacity
from forecastlab.operators.intervals import visible_pairs
from forecastlab.operators.reshape import dense_grid
from forecastlab.plans import area, truth
from forecastlab.session import settle

CELLS_SQL = """
SELECT windpark_nve_id, time_ref, time FROM v_forecast_wide JOIN v_units ON sid = windpark_statnet
WHERE time_ref > production_start_date"""

AREA_CELLS_SQL = """
SELECT DISTINCT time_ref, time, bidding_area FROM v_forecast_wide JOIN v_units ON sid = windpark_statnet"""


def unit_cells(lab):
    return (
        lab.forecast_wide.select(F.col("sid").alias("windpark_statnet"), "time_ref", "time")
        .join(lab.units.select("windpark_nve_id", "windpark_statnet", "production_start_date"), "windpark_statnet")
        .filter(F.col("time_ref") > F.col("production_start_date"))
        .select("windpark_nve_id", "time_ref", "time")
    )


def area_cells(lab):
    return (
        lab.forecast_wide.select(F.col("sid").alias("windpark_statnet"), "time_ref", "time")
        .join(lab.units.select("windpark_statnet", "bidding_area"), "windpark_statnet")
        .select("time_ref", "time", "bidding_area").distinct()
    )


@check("join_inner_multi", """
SELECT f.sid, f.time_ref, f.lt, f.ws10m_00, n.wind_speed_10m
FROM v_forecast_wide f JOIN v_nowcast n ON f.sid = n.windpark AND f.time_ref = n.time""")
def _(lab):
    now = lab.nowcast.select(F.col("windpark").alias("sid"), F.col("time").alias("time_ref"), "wind_speed_10m")
    return lab.forecast_wide.select("sid", "time_ref", "lt", "ws10m_00").join(now, ["sid", "time_ref"])


@check("join_left_multi", f"""
SELECT windpark_nve_id, time_ref, time, local_power FROM ({CELLS_SQL}) LEFT JOIN v_unit_power USING (windpark_nve_id, time)""")
def _(lab):
    return unit_cells(lab).join(lab.unit_power, ["windpark_nve_id", "time"], "left").select(
        "windpark_nve_id", "time_ref", "time", "local_power"
    )


@check("join_cross_grid", """
SELECT windpark_nve_id, time_ref, time FROM v_units CROSS JOIN (SELECT DISTINCT time_ref, time FROM v_forecast_wide)""")
def _(lab):
    return dense_grid(lab.units.select("windpark_nve_id"), lab.forecast_wide.select("time_ref", "time"))


@check("join_active_capacity", """
SELECT p.time, p.bidding_area, sum(u.operating_power_max) AS operating_power_max, sum(u.mean_production) AS mean_production,
       CAST(sum(u.num_turbines) AS BIGINT) AS num_turbines
FROM v_area_power p JOIN v_units u ON u.bidding_area = p.bidding_area AND p.time >= u.production_start_date
GROUP BY 1, 2""")
def _(lab):
    return active_capacity(lab.area_power, lab.units)


@check("join_interval_visible", f"""
SELECT c.windpark_nve_id, c.time_ref, c.time, o.messageId, o.eventStart, o.unavailableCapacity
FROM ({CELLS_SQL}) c JOIN v_outage o USING (windpark_nve_id)
WHERE c.time_ref > o.publicationDate AND c.time >= o.eventStart AND c.time <= o.eventStop""")
def _(lab):
    return visible_pairs(unit_cells(lab), lab.outages, ["windpark_nve_id"]).select(
        "windpark_nve_id", "time_ref", "time", "messageId", "eventStart", "unavailableCapacity"
    )


@check("join_interval_area", f"""
SELECT c.bidding_area, c.time_ref, c.time, t.messageId, t.unplannedEvent, t.eventStart
FROM ({AREA_CELLS_SQL}) c LEFT JOIN v_transmission t ON right(c.bidding_area, 3) = t.outAreaName
WHERE c.time_ref > t.publicationDate AND c.time >= t.eventStart AND c.time <= t.eventStop""")
def _(lab):
    rows = area_cells(lab).withColumn("outAreaName", last_chars("bidding_area", 3))
    return visible_pairs(rows, lab.transmission, ["outAreaName"]).select(
        "bidding_area", "time_ref", "time", "messageId", "unplannedEvent", "eventStart"
    )


@check("join_interval_back", f"""
SELECT c.bidding_area, c.time_ref, c.time, coalesce(k.flag, false) AS unplannedEvent, round(coalesce(k.share, 0), 6) AS unavailable_transmission
FROM ({AREA_CELLS_SQL}) c LEFT JOIN (
  SELECT c.bidding_area, c.time_ref, c.time, bool_or(t.unplannedEvent) AS flag,
         sum(t.unavailableCapacity) / sum(t.installedCapacity) AS share
  FROM ({AREA_CELLS_SQL}) c JOIN v_transmission t ON right(c.bidding_area, 3) = t.outAreaName
  WHERE c.time_ref > t.publicationDate AND c.time >= t.eventStart AND c.time <= t.eventStop GROUP BY 1, 2, 3) k
USING (bidding_area, time_ref, time)""")
def _(lab):
    return area.with_transmission(settle(area_cells(lab), "cells"), lab.transmission).withColumn(
        "unavailable_transmission", r6("unavailable_transmission")
    )


@check("join_horizon_pairs", """
SELECT i.bidding_area, i.time AS time_ref, p.time, CAST(date_diff('hour', i.time, p.time) AS BIGINT) AS lt, round(p.power, 6) AS y_true
FROM v_area_power i JOIN v_area_power p ON i.bidding_area = p.bidding_area
     AND CAST(p.time AS DATE) = CAST(i.time + INTERVAL '2' DAY AS DATE)
WHERE hour(i.time) = 9""")
def _(lab):
    return truth.evaluation_set(lab.area_power).withColumn("y_true", r6("y_true"))


@check("join_full_outer", """
SELECT a.windpark_nve, a.windpark_nve_id, b.site, b.capacity
FROM v_lookup a FULL OUTER JOIN
  (SELECT 'Supplier#' || lpad(CAST(windpark_nve_id + 3 AS VARCHAR), 9, '0') AS site, operating_power_max AS capacity FROM v_units) b
  ON a.windpark_nve = b.site""")
def _(lab):
    return matching.full_match(lab.lookup.select("windpark_nve", "windpark_nve_id"), _sites(lab), "windpark_nve", "site")


def _sites(lab):
    name = F.concat(F.lit("Supplier#"), F.lpad((F.col("windpark_nve_id") + 3).cast("string"), 9, "0"))
    return lab.units.select(name.alias("site"), F.col("operating_power_max").alias("capacity"))


@check("join_unmatched", """
SELECT a.windpark_nve, b.site
FROM v_lookup a FULL OUTER JOIN
  (SELECT 'Supplier#' || lpad(CAST(windpark_nve_id + 3 AS VARCHAR), 9, '0') AS site FROM v_units) b ON a.windpark_nve = b.site
WHERE a.windpark_nve IS NULL OR b.site IS NULL""")
def _(lab):
    return matching.unmatched(lab.lookup.select("windpark_nve"), _sites(lab).select("site"), "windpark_nve", "site")


@check("join_anti_member", """
SELECT messageId, eic FROM v_production_outage p WHERE NOT EXISTS (SELECT 1 FROM v_lookup l WHERE l.eic_code = p.eic)""")
def _(lab):
    from forecastlab.sources.messages import production_outages

    flat = production_outages(lab.messages).select("messageId", "eic")
    return matching.absent_from(flat, "eic", lab.lookup, "eic_code")


MARKET_SQL = """
SELECT messageId, 'NO' || ((o_custkey + a) % 6 + 1) AS areaName, o_orderkey % 4 <> 0 AS has_asset,
       CASE WHEN o_orderkey % 4 <> 0 THEN CASE o_orderkey % 3 WHEN 0 THEN 'Supplier#' || lpad(CAST(o_custkey // 15 AS VARCHAR), 9, '0')
            WHEN 1 THEN 'ST' || (o_custkey // 15 // 2) END END AS name,
       CASE WHEN o_orderkey % 4 <> 0 AND o_orderkey % 5 <> 0 THEN 'EIC' || (o_custkey // 15 + o_orderkey % 2) END AS eic
FROM v_message, generate_series(0, 1) AS g(a) WHERE messageType = 5 AND a <= o_orderkey % 2"""


@check("join_any_key", f"""
SELECT messageId, areaName, windpark_nve_id FROM ({MARKET_SQL}) m JOIN v_lookup l
  ON m.eic = l.eic_code OR m.name = l.windpark_nve OR m.name = l.windpark_statnet OR m.name = l.bidding_area
WHERE m.eic IS NOT NULL AND m.areaName IN ('NO1', 'NO2', 'NO3', 'NO4')""")
def _(lab):
    from forecastlab.sources.messages import AREA_NAMES, market_information

    named = market_information(lab.messages).filter(F.col("eic").isNotNull() & F.col("areaName").isin(*AREA_NAMES))
    pairs = [("eic", "eic_code"), ("name", "windpark_nve"), ("name", "windpark_statnet"), ("name", "bidding_area")]
    return matching.any_key_join(named, lab.lookup, pairs).select("messageId", "areaName", "windpark_nve_id")


@check("join_pred_truth", """
SELECT t.bidding_area, t.time_ref, t.time, t.lt, round(t.y_true, 6) AS y_true, round(coalesce(p.y_pred, 0), 6) AS y_pred,
       p.y_pred IS NULL AS filled
FROM (SELECT i.bidding_area, i.time AS time_ref, p.time, CAST(date_diff('hour', i.time, p.time) AS BIGINT) AS lt, p.power AS y_true
      FROM v_area_power i JOIN v_area_power p ON i.bidding_area = p.bidding_area
           AND CAST(p.time AS DATE) = CAST(i.time + INTERVAL '2' DAY AS DATE) WHERE hour(i.time) = 9) t
LEFT JOIN (SELECT time_ref, time, bidding_area, avg(s) AS y_pred FROM (
      SELECT time_ref, time, bidding_area, em, sum(local_power_pred) AS s FROM v_local_pred GROUP BY ALL) GROUP BY ALL) p
  USING (bidding_area, time_ref, time)""")
def _(lab):
    pairs = truth.with_prediction(
        truth.evaluation_set(lab.area_power), truth.ensemble_mean_prediction(lab.local_pred),
        ["bidding_area", "time_ref", "time"],
    )
    return pairs.withColumns({"y_true": r6("y_true"), "y_pred": r6("y_pred")})


@check("join_horizontal", """
SELECT f.sid, f.time_ref, f.lt, f.ws10m_00, round(f.ws10m_00 * 2 + n.wind_speed_10m, 6) AS y_pred
FROM v_forecast_wide f JOIN v_nowcast n ON f.sid = n.windpark AND f.time_ref = n.time""")
def _(lab):
    # Predictions keep their keys, so they come back by key and not by position.
    ids = ["sid", "time_ref", "lt"]
    rows = lab.forecast_wide.select(*ids, "ws10m_00")
    now = lab.nowcast.select(F.col("windpark").alias("sid"), F.col("time").alias("time_ref"), "wind_speed_10m")
    predicted = rows.join(now, ["sid", "time_ref"]).select(*ids, r6(F.col("ws10m_00") * 2 + F.col("wind_speed_10m")).alias("y_pred"))
    return rows.join(predicted, ids)
