"""The input tables as DuckDB SQL, for the oracle side of each check.

``compose`` puts the views a statement uses in front of it as common table expressions.
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}

VIEWS["v_units"] = """
SELECT s_suppkey AS windpark_nve_id, s_name AS windpark_nve, 'ST' || (s_suppkey // 2) AS windpark_statnet,
       'ELSPOT NO' || (n_regionkey + 1) AS bidding_area,
       TIMESTAMP '1995-01-01 00:00:00' + CAST(s_suppkey * 37 % 2000 AS INT) * INTERVAL '1' DAY AS production_start_date,
       CAST(10 + s_suppkey % 90 AS DOUBLE) AS operating_power_max,
       CAST(1000 + s_suppkey * 11 % 3000 AS DOUBLE) AS mean_production,
       CAST(60 + s_suppkey * 7 % 80 AS DOUBLE) AS mean_hub_height,
       CAST(70 + s_suppkey * 3 % 80 AS DOUBLE) AS mean_rotor_diameter,
       CAST(1 + s_suppkey % 40 AS BIGINT) AS num_turbines,
       CAST(s_suppkey * 37 % 900 AS DOUBLE) AS elevation,
       (s_suppkey * 17 % 300) / 10 AS ruggedness
FROM supplier JOIN nation ON s_nationkey = n_nationkey"""

VIEWS["v_lookup"] = """
SELECT windpark_nve_id, windpark_nve, windpark_statnet, bidding_area, 'EIC' || windpark_nve_id AS eic_code
FROM v_units"""

VIEWS["v_forecast_base"] = """
SELECT 'ST' || (l_suppkey // 2) AS sid,
       date_trunc('week', l_shipdate) + INTERVAL '9' HOUR AS time_ref,
       CAST(15 + 6 * ((l_orderkey + l_linenumber) % 8) AS BIGINT) AS lt,
       min(l_quantity) / 2 AS ws, CAST(min(l_partkey * 29 % 360) AS DOUBLE) AS wd,
       min(l_discount) * 300 - 10 AS t2, 40 + min(l_tax) * 700 AS rh,
       CAST(980 + min(l_partkey % 50) AS DOUBLE) AS ms, CAST(min(l_linenumber) AS DOUBLE) AS gust
FROM lineitem GROUP BY 1, 2, 3"""

VIEWS["v_forecast_wide"] = (
    "SELECT sid, time_ref, time_ref + CAST(lt AS INT) * INTERVAL '1' HOUR AS time, lt, "
    + ", ".join(
        f"ws * {(757 + 32 * em) / 1009!r}e0 AS ws10m_{em:02d}, wd + {4 * em} AS wd10m_{em:02d}, t2 + {em / 8} AS t2m_{em:02d},"
        f" rh AS rh2m_{em:02d}, ms + {em / 4} AS mslp_{em:02d}, ws * {(757 + 32 * em) / 1009!r}e0 + gust AS g10m_{em:02d}"
        for em in range(15)
    )
    + " FROM v_forecast_base"
)

VIEWS["v_forecast"] = """
SELECT sid AS windpark_statnet, time_ref, time_ref + CAST(lt AS INT) * INTERVAL '1' HOUR AS time, lt,
       CAST(em AS INT) AS em, ws * ((757 + 32 * em) / 1009) AS ws10m, wd + 4 * em AS wd10m, t2 + em / 8 AS t2m,
       rh AS rh2m, ms + em / 4 AS mslp, ws * ((757 + 32 * em) / 1009) + gust AS g10m
FROM v_forecast_base, generate_series(0, 14) AS g(em)"""

VIEWS["v_nowcast"] = """
SELECT 'ST' || (l_suppkey // 2) AS windpark, l_shipdate + INTERVAL '9' HOUR AS time,
       min(l_discount) * 300 - 10 AS air_temperature_2m,
       CAST(980 + min(l_partkey % 50) AS DOUBLE) AS air_pressure_at_sea_level,
       40 + min(l_tax) * 700 AS relative_humidity_2m, min(l_linenumber) / 2 AS precipitation_amount,
       max(l_quantity) / 2 AS wind_speed_10m, CAST(min(l_partkey * 29 % 360) AS DOUBLE) AS wind_direction_10m
FROM lineitem GROUP BY 1, 2"""

VIEWS["v_production"] = """
SELECT l_suppkey AS windpark_nve_id,
       l_shipdate + CAST([0, 6, 9, 12, 18][l_orderkey % 5 + 1] AS INT) * INTERVAL '1' HOUR AS time,
       l_quantity, CAST(round(l_quantity * (1 + l_tax) * 100) AS BIGINT) AS delivered
FROM lineitem"""

VIEWS["v_unit_power"] = """
SELECT windpark_nve_id, time, sum(l_quantity) AS local_power FROM v_production GROUP BY 1, 2"""

VIEWS["v_area_power"] = """
SELECT time, bidding_area, CAST(sum(delivered) * 50 AS DOUBLE) / 1009 AS power
FROM v_production JOIN v_units USING (windpark_nve_id) GROUP BY 1, 2"""

VIEWS["v_hourly"] = """
SELECT date_trunc('hour', ts) AS time,
       CASE event_type WHEN 'click' THEN 'ELSPOT NO1' WHEN 'error' THEN 'ELSPOT NO2'
            WHEN 'purchase' THEN 'ELSPOT NO3' WHEN 'signup' THEN 'ELSPOT NO4' ELSE 'ELSPOT NO5' END AS bidding_area,
       CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 100 AS power
FROM events GROUP BY 1, 2"""

VIEWS["v_hourly_wide"] = (
    "SELECT time AS __index_level_0__, "
    + ", ".join(f"max(power) FILTER (WHERE bidding_area = 'ELSPOT NO{k}') AS \"ELSPOT NO{k}\"" for k in range(1, 6))
    + " FROM v_hourly GROUP BY 1"
)

VIEWS["v_local_pred"] = """
SELECT time_ref, time, lt, windpark_nve AS windpark, bidding_area, em,
       operating_power_max * least(ws10m / 30, 1.0) AS local_power_pred
FROM v_forecast JOIN v_units USING (windpark_statnet)
WHERE time_ref > production_start_date"""

VIEWS["v_message"] = """
SELECT 'M' || o_orderkey AS messageId, o_orderkey, o_custkey,
       CASE WHEN o_orderpriority IN ('1-URGENT', '4-NOT SPECIFIED') THEN 1
            WHEN o_orderpriority IN ('2-HIGH', '5-LOW') THEN 3 ELSE 5 END AS messageType,
       CAST(1 + o_orderkey % 2 AS INT) AS unavailabilityType, o_orderpriority AS remarks,
       o_orderdate + CAST(o_orderkey % 24 AS INT) * INTERVAL '1' HOUR AS publicationDate,
       o_orderdate + INTERVAL '1' DAY AS first_day, o_orderkey % 7 = 0 AS generation
FROM orders"""

VIEWS["v_period"] = """
SELECT m.*, CAST(50 + o_custkey % 50 AS DOUBLE) AS installedCapacity,
       CAST(10 + (o_custkey + j) % 40 AS DOUBLE) AS unavailableCapacity,
       CAST(50 + o_custkey % 50 AS DOUBLE) - CAST(10 + (o_custkey + j) % 40 AS DOUBLE) AS availableCapacity,
       first_day + CAST(o_orderkey % 4 * 6 + 48 * j AS INT) * INTERVAL '1' HOUR AS eventStart,
       first_day + CAST(o_orderkey % 4 * 6 + 48 * j + (1 + o_orderkey % 5) * 12 AS INT) * INTERVAL '1' HOUR AS eventStop
FROM v_message m, generate_series(0, 1) AS g(j) WHERE j <= (o_orderkey // 2) % 2"""

VIEWS["v_production_outage"] = """
SELECT messageId, unavailabilityType = 1 AS unplannedEvent, publicationDate, 'EIC' || (o_custkey // 15 + u) AS eic,
       installedCapacity, unavailableCapacity, availableCapacity, eventStart, eventStop
FROM v_period, generate_series(0, 1) AS h(u) WHERE messageType = 1 AND NOT generation AND u <= o_orderkey % 2"""

VIEWS["v_outage"] = """
SELECT messageId, unplannedEvent, publicationDate, windpark_nve_id, installedCapacity, unavailableCapacity,
       availableCapacity, eventStart, eventStop
FROM v_production_outage JOIN v_lookup ON eic = eic_code"""

VIEWS["v_transmission"] = """
SELECT messageId, unavailabilityType = 1 AS unplannedEvent, publicationDate,
       'NO' || (o_custkey % 6 + 1) AS outAreaName, 'NO' || ((o_custkey + 1) % 6 + 1) AS inAreaName,
       installedCapacity, unavailableCapacity, availableCapacity, eventStart, eventStop
FROM v_period WHERE messageType = 3 AND o_custkey % 6 < 4 AND eventStop > TIMESTAMP '1995-06-01 00:00:00'"""

VIEWS["v_register"] = """
SELECT windpark_nve_id, windpark_nve, windpark_statnet, bidding_area, production_start_date, operating_power_max,
       CASE WHEN windpark_nve_id % 11 <> 0 THEN mean_hub_height END AS hub, mean_production, mean_rotor_diameter, num_turbines,
       CAST(2000 + windpark_nve_id % 10 * 100 AS DOUBLE) AS kw_a, 1 + windpark_nve_id % 7 AS n_a,
       CAST(3000 + windpark_nve_id % 5 * 100 AS DOUBLE) AS kw_b, windpark_nve_id % 4 AS n_b
FROM v_units"""

VIEWS["v_raster"] = "SELECT p_partkey % 40 AS ix, p_partkey // 40 AS iy, p_retailprice AS value FROM part"

VIEWS["v_points"] = """
SELECT s_suppkey AS windpark_nve_id, (s_suppkey * 7 % 164) / 4 AS x, (s_suppkey * 11 % 100) / 8 AS y FROM supplier"""


VIEWS["v_truth"] = """
SELECT i.bidding_area, i.time AS time_ref, p.time, CAST(date_diff('hour', i.time, p.time) AS BIGINT) AS lt, p.power AS y_true
FROM v_area_power i JOIN v_area_power p ON i.bidding_area = p.bidding_area
     AND CAST(p.time AS DATE) = CAST(i.time + INTERVAL '2' DAY AS DATE)
WHERE hour(i.time) = 9"""

VIEWS["v_member_sum"] = """
SELECT time_ref, time, lt, bidding_area, em, sum(local_power_pred) AS sum_local_pred FROM v_local_pred GROUP BY ALL"""

VIEWS["v_ensemble_mean"] = """
SELECT time_ref, time, bidding_area, avg(sum_local_pred) AS y_pred FROM v_member_sum GROUP BY ALL"""

VIEWS["v_scored"] = """
SELECT t.*, coalesce(p.y_pred, 0) AS y_pred, p.y_pred IS NULL AS filled
FROM v_truth t LEFT JOIN v_ensemble_mean p USING (bidding_area, time_ref, time)"""

VIEWS["v_capacity"] = """
SELECT p.time, p.bidding_area, sum(u.operating_power_max) AS operating_power_max, sum(u.mean_production) AS mean_production,
       CAST(sum(u.num_turbines) AS BIGINT) AS num_turbines
FROM v_area_power p JOIN v_units u ON u.bidding_area = p.bidding_area AND p.time >= u.production_start_date GROUP BY 1, 2"""

VIEWS["v_relative"] = """
SELECT *, power / operating_power_max AS relative_power FROM v_area_power JOIN v_capacity USING (bidding_area, time)"""

VIEWS["v_recent"] = """
SELECT *, relative_power AS last_power,
       CASE WHEN count(relative_power) OVER w = 24 THEN avg(relative_power) OVER w END AS recent_mean,
       CASE WHEN count(relative_power) OVER w = 24 THEN max(relative_power) OVER w END AS recent_max,
       CASE WHEN count(relative_power) OVER w = 24 THEN min(relative_power) OVER w END AS recent_min,
       CASE WHEN count(relative_power) OVER w = 24 THEN max(relative_power) OVER w - min(relative_power) OVER w END AS recent_range,
       CASE WHEN count(relative_power) OVER w = 24 THEN stddev_samp(relative_power) OVER w END AS recent_std,
       relative_power - lag(relative_power) OVER (PARTITION BY bidding_area ORDER BY time) AS ramp
FROM v_relative WINDOW w AS (PARTITION BY bidding_area ORDER BY time ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"""

VIEWS["v_unit_cell"] = """
SELECT windpark_nve_id, time_ref, time FROM v_forecast_wide JOIN v_units ON sid = windpark_statnet
WHERE time_ref > production_start_date"""

VIEWS["v_area_cell"] = """
SELECT DISTINCT time_ref, time, bidding_area FROM v_forecast_wide JOIN v_units ON sid = windpark_statnet"""

VIEWS["v_outage_hour"] = """
SELECT windpark_nve_id, publicationDate, unavailableCapacity, installedCapacity, unnest(generate_series(
         CASE WHEN date_trunc('hour', eventStart) < eventStart THEN date_trunc('hour', eventStart) + INTERVAL 1 HOUR ELSE eventStart END,
         eventStop, INTERVAL 1 HOUR)) AS time
FROM v_outage"""

VIEWS["v_unit_share"] = """
SELECT windpark_nve_id, c.time_ref, time, sum(o.unavailableCapacity) AS unavailableCapacity,
       sum(o.installedCapacity) AS installedCapacity,
       sum(o.unavailableCapacity) / sum(o.installedCapacity) AS unavailable_capacity
FROM v_unit_cell c JOIN v_outage_hour o USING (windpark_nve_id, time)
WHERE c.time_ref > o.publicationDate GROUP BY 1, 2, 3"""

VIEWS["v_area_share"] = """
SELECT c.bidding_area, c.time_ref, c.time, bool_or(t.unplannedEvent) AS unplannedEvent,
       sum(t.unavailableCapacity) / sum(t.installedCapacity) AS unavailable_transmission
FROM v_area_cell c JOIN v_transmission t ON right(c.bidding_area, 3) = t.outAreaName
WHERE c.time_ref > t.publicationDate AND c.time >= t.eventStart AND c.time <= t.eventStop GROUP BY 1, 2, 3"""

VIEWS["v_local_sum"] = """
SELECT time, bidding_area, sum(local_power) AS local_power FROM v_unit_power JOIN v_units USING (windpark_nve_id) GROUP BY 1, 2"""


VIEWS["v_nowcast_feat"] = """
SELECT windpark AS windpark_statnet, time AS time_ref, air_temperature_2m AS now_air_temperature_2m,
       air_pressure_at_sea_level AS now_air_pressure_at_sea_level, relative_humidity_2m AS now_relative_humidity_2m,
       precipitation_amount AS now_precipitation_amount, wind_speed_10m AS now_wind_speed_10m,
       wind_direction_10m AS now_wind_direction_10m,
       air_pressure_at_sea_level / (273.15 + air_temperature_2m) AS now_air_density,
       avg(wind_speed_10m) OVER (PARTITION BY windpark ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS location_mean_ws,
       sqrt(pow(list_sum(list_transform(lx, lambda v, i: v * pow(0.5, len(lx) - i))), 2)
          + pow(list_sum(list_transform(ly, lambda v, i: v * pow(0.5, len(ly) - i))), 2))
         / list_sum(list_transform(lx, lambda v, i: pow(0.5, len(lx) - i))) AS now_wind_alignment,
       air_pressure_at_sea_level / (273.15 + air_temperature_2m) * pow(least(greatest(wind_speed_10m, 0), 20), 3) AS now_wind_power_density
FROM (SELECT *, list(wind_speed_10m * cos(2 * pi() * wind_direction_10m / 360)) OVER w AS lx,
             list(wind_speed_10m * sin(2 * pi() * wind_direction_10m / 360)) OVER w AS ly
      FROM v_nowcast WINDOW w AS (PARTITION BY windpark ORDER BY time ROWS BETWEEN 63 PRECEDING AND CURRENT ROW))"""

VIEWS["v_site_weather"] = """
SELECT windpark_nve_id, time_ref, time, lt, em, ws10m, wd10m, t2m, rh2m, mslp, g10m, mean_hub_height, elevation
FROM v_forecast JOIN v_units USING (windpark_statnet)"""

HUB_AIR = """
SELECT *, phh / (287.05 * tv) AS adhh, 0.5 * (phh / (287.05 * tv)) * pow(least(greatest(wshh, 0), 25), 3) AS wind_power_density
FROM (SELECT *, ws10m * pow(mean_hub_height / 10, 0.143) AS wshh,
             mslp * 100 * exp(-9.80665 * (elevation + mean_hub_height) / (287.05 * tv)) AS phh
      FROM (SELECT *, layer * (1 + 0.61 * (0.622 * e / (p0 - 0.378 * e))) AS tv
            FROM (SELECT *, mslp * 100 * exp(-9.80665 * elevation / (287.05 * layer)) AS p0
                  FROM (SELECT *, t2m + 273.15 - 0.0065 * mean_hub_height AS layer,
                               rh2m / 100 * (6.112 * exp((17.67 * t2m) / (t2m + 243.5))) * 100 AS e FROM {source}))))"""

VIEWS["v_area_dataset"] = """
SELECT time_ref, time, bidding_area, power, relative_power, operating_power_max, mean_production, num_turbines, last_power,
       recent_mean, ramp, recent_max, recent_min, recent_range, recent_std, lt, coalesce(s.unplannedEvent, false) AS unplannedEvent,
       coalesce(s.unavailable_transmission, 0) AS unavailable_transmission, mean_sum_pred, std_sum_pred, min_sum_pred, max_sum_pred,
       lag(mean_sum_pred, 1) OVER w AS pred_lag1, lag(mean_sum_pred, 2) OVER w AS pred_lag2,
       lead(mean_sum_pred, 1) OVER w AS pred_lead1, lead(mean_sum_pred, 2) OVER w AS pred_lead2
FROM (
  SELECT m.time_ref, m.time, m.lt, m.bidding_area, any_value(t.power) AS power, any_value(t.relative_power) AS relative_power,
         any_value(r.operating_power_max) AS operating_power_max, any_value(r.mean_production) AS mean_production,
         any_value(r.num_turbines) AS num_turbines, any_value(r.last_power) AS last_power, any_value(r.recent_mean) AS recent_mean,
         any_value(r.ramp) AS ramp, any_value(r.recent_max) AS recent_max, any_value(r.recent_min) AS recent_min,
         any_value(r.recent_range) AS recent_range, any_value(r.recent_std) AS recent_std,
         avg(sum_local_pred / r.operating_power_max) AS mean_sum_pred, stddev_samp(sum_local_pred / r.operating_power_max) AS std_sum_pred,
         min(sum_local_pred / r.operating_power_max) AS min_sum_pred, max(sum_local_pred / r.operating_power_max) AS max_sum_pred
  FROM v_member_sum m JOIN v_recent r ON m.time_ref = r.time AND m.bidding_area = r.bidding_area
       JOIN v_relative t ON m.time = t.time AND m.bidding_area = t.bidding_area
  GROUP BY 1, 2, 3, 4) d
LEFT JOIN v_area_share s USING (bidding_area, time_ref, time)
WINDOW w AS (PARTITION BY time_ref, bidding_area ORDER BY time)"""


VIEWS["v_local_row"] = """
SELECT time_ref, time, lt, windpark_nve AS windpark, bidding_area, em, operating_power_max, mean_hub_height,
       local_power / operating_power_max AS local_relative_power, ws10m, t2m, mslp, g10m
FROM v_forecast JOIN v_units USING (windpark_statnet) LEFT JOIN v_unit_power USING (windpark_nve_id, time)
WHERE time_ref > production_start_date"""

VIEWS["v_block"] = """
SELECT start, coalesce(lead(start) OVER (ORDER BY start), TIMESTAMP '9999-01-01 00:00:00') AS stop FROM (
  SELECT min(time_ref) AS start FROM v_local_row WHERE local_relative_power IS NOT NULL AND time_ref >= TIMESTAMP '1998-01-01 00:00:00'
  GROUP BY date_trunc('month', time_ref))"""

# Weighted straight line of relative power on wind speed, member 0, all rows before each block.
VIEWS["v_block_fit"] = """
SELECT start, stop, n, (sw * sxy - sx * sy) / (sw * sxx - sx * sx) AS slope,
       (sy - (sw * sxy - sx * sy) / (sw * sxx - sx * sx) * sx) / sw AS intercept
FROM (SELECT start, any_value(stop) AS stop, count(*) AS n, sum(w) AS sw, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy
      FROM v_block JOIN (SELECT time_ref, operating_power_max AS w, ws10m AS x, local_relative_power AS y FROM v_local_row
                         WHERE em = 0 AND local_relative_power IS NOT NULL) r ON r.time_ref < start GROUP BY 1)"""

VIEWS["v_rolling"] = """
SELECT time_ref, time, bidding_area, avg(s) AS y_pred FROM (
  SELECT time_ref, time, bidding_area, em, sum((intercept + slope * ws10m) * operating_power_max) AS s
  FROM v_local_row JOIN v_block_fit ON time_ref >= start AND time_ref < stop GROUP BY ALL) GROUP BY ALL"""

VIEWS["v_hour_truth"] = """
SELECT i.bidding_area, i.time AS time_ref, p.time, CAST(date_diff('hour', i.time, p.time) AS BIGINT) AS lt, p.power AS y_true
FROM v_hourly i JOIN v_hourly p ON i.bidding_area = p.bidding_area
     AND CAST(p.time AS DATE) = CAST(i.time + INTERVAL '2' DAY AS DATE)
WHERE hour(i.time) = 9"""

VIEWS["v_hour_lags"] = """
SELECT bidding_area, time, power AS y, lag(power, 1) OVER w AS y1, lag(power, 2) OVER w AS y2, row_number() OVER w - 1 AS pos
FROM v_hourly WINDOW w AS (PARTITION BY bidding_area ORDER BY time)"""

AR2_SOLUTION = """
SELECT *, (sy - phi1 * s1 - phi2 * s2) / n AS const,
       (syy - sy * sy / n) - phi1 * (s1y - s1 * sy / n) - phi2 * (s2y - s2 * sy / n) AS ssr
FROM (SELECT *, ((s22 - s2 * s2 / n) * (s1y - s1 * sy / n) - (s12 - s1 * s2 / n) * (s2y - s2 * sy / n)) / det AS phi1,
             ((s11 - s1 * s1 / n) * (s2y - s2 * sy / n) - (s12 - s1 * s2 / n) * (s1y - s1 * sy / n)) / det AS phi2
      FROM (SELECT *, (s11 - s1 * s1 / n) * (s22 - s2 * s2 / n) - (s12 - s1 * s2 / n) * (s12 - s1 * s2 / n) AS det FROM {source}))"""

VIEWS["v_ar2"] = AR2_SOLUTION.format(source="""
(SELECT bidding_area, time AS time_ref, y, y1, 198.0 AS n, sum(y1) OVER w AS s1, sum(y2) OVER w AS s2, sum(y) OVER w AS sy,
        sum(y1 * y1) OVER w AS s11, sum(y2 * y2) OVER w AS s22, sum(y1 * y2) OVER w AS s12, sum(y1 * y) OVER w AS s1y,
        sum(y2 * y) OVER w AS s2y, sum(y * y) OVER w AS syy, pos
 FROM v_hour_lags WINDOW w AS (PARTITION BY bidding_area ORDER BY time ROWS BETWEEN 197 PRECEDING AND CURRENT ROW))""") + """
WHERE pos >= 199 AND hour(time_ref) = 9"""

# The same over area production, and the evaluation set that all models of the report are scored on.
VIEWS["v_asked"] = "SELECT * FROM v_truth WHERE time_ref >= TIMESTAMP '1999-01-01 00:00:00'"
VIEWS["v_area_lags"] = VIEWS["v_hour_lags"].replace("v_hourly", "v_area_power")
VIEWS["v_ar2_area"] = VIEWS["v_ar2"].replace("v_hour_lags", "v_area_lags")


def compose(body: str) -> str:
    """Statement with the views it reads, directly or through other views, as leading CTEs."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(VIEWS[name])
                needed.append(name)

    visit(body)
    if not needed:
        return body
    ordered = [n for n in needed]
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in ordered)
    stripped = body.strip()
    if re.match(r"(?i)with\s+recursive\b", stripped):
        return f"WITH RECURSIVE {ctes},\n" + re.sub(r"(?i)^with\s+recursive\s+", "", stripped)
    if re.match(r"(?i)with\b", stripped):
        return f"WITH {ctes},\n" + re.sub(r"(?i)^with\s+", "", stripped)
    return f"WITH {ctes}\n{stripped}"
