"""Window functions (survey 2.5)."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from forecastlab.catalog.registry import check
from forecastlab.catalog.rows import r6
from forecastlab.functions import physics
from forecastlab.functions.scalars import ratio
from forecastlab.operators import series
from forecastlab.operators.ranks import exact_quantiles, first_per_key
from forecastlab.plans import area, backtest, local, summaries, truth
from forecastlab.plans.units import unit_sites
from forecastlab.session import settle
from forecastlab.sources.schemas import MEMBERS


def _recent(lab, columns, compat=False):
    block = area.recent_block(area.relative_power(lab.area_power, lab.units), compat)
    return block.select("bidding_area", "time", *[r6(c).alias(c) for c in columns])


CENTRED = ", ".join(
    f"round(avg(ws10m_{em:02d} * {f}(2 * pi() * wd10m_{em:02d} / 360)) OVER w, 6) AS {n}_{em:02d}" for em in MEMBERS for n, f in (("x", "cos"), ("y", "sin"))
)


@check("win_centered_mean3", f"""
SELECT sid, time_ref, lt, {CENTRED}
FROM v_forecast_wide WINDOW w AS (PARTITION BY sid, time_ref ORDER BY lt ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""")
def _(lab):
    near = Window.partitionBy("sid", "time_ref").orderBy("lt").rowsBetween(-1, 1)
    parts = [(n, f, em) for em in MEMBERS for n, f in (("x", physics.wind_x), ("y", physics.wind_y))]
    return lab.forecast_wide.select(
        "sid", "time_ref", "lt", *[r6(F.avg(f(f"ws10m_{em:02d}", f"wd10m_{em:02d}")).over(near)).alias(f"{n}_{em:02d}") for n, f, em in parts]
    )


@check("win_rolling24_mean", "SELECT bidding_area, time, round(recent_mean, 6) AS recent_mean FROM v_recent")
def _(lab):
    return _recent(lab, ["recent_mean"])


@check("win_rolling24_minmax", """
SELECT bidding_area, time, round(recent_max, 6) AS recent_max, round(recent_min, 6) AS recent_min, round(recent_range, 6) AS recent_range FROM v_recent""")
def _(lab):
    return _recent(lab, ["recent_max", "recent_min", "recent_range"])


@check("win_rolling24_std", """
SELECT bidding_area, time, round(recent_std, 6) AS recent_std, 'std' AS form FROM v_recent
UNION ALL SELECT bidding_area, time, round(recent_min, 6), 'compat' FROM v_recent""")
def _(lab):
    std = _recent(lab, ["recent_std"]).withColumn("form", F.lit("std"))
    return std.unionByName(_recent(lab, ["recent_std"], compat=True).withColumn("form", F.lit("compat")))


@check("win_ramp", "SELECT bidding_area, time, round(ramp, 6) AS ramp FROM v_recent")
def _(lab):
    return _recent(lab, ["ramp"])


@check("win_lag_lead", """
SELECT bidding_area, time_ref, time, """ + ", ".join(
    f"round({f}(y_pred, {k}) OVER w, 6) AS pred_{f}{k}" for f in ("lag", "lead") for k in (1, 2))
    + " FROM v_ensemble_mean WINDOW w AS (PARTITION BY time_ref, bidding_area ORDER BY time)")
def _(lab):
    near = area.neighbours(truth.ensemble_mean_prediction(lab.local_pred), "y_pred")
    names = [f"pred_{f}{k}" for f in ("lag", "lead") for k in (1, 2)]
    return near.select("bidding_area", "time_ref", "time", *[r6(n).alias(n) for n in names])


@check("win_lag_fan", "SELECT bidding_area, time, "
       + ", ".join(f"lag(power, {k}) OVER w AS lag_{k:02d}" for k in range(1, 25))
       + " FROM v_hourly WINDOW w AS (PARTITION BY bidding_area ORDER BY time)")
def _(lab):
    fan = series.series_columns(
        lab.hourly, ["bidding_area"], "time",
        lambda w: {f"lag_{k:02d}": F.lag("power", k).over(w) for k in range(1, 25)}, before=24,
    )
    return fan.drop("power")


@check("win_ewm_alpha", """
SELECT windpark, time, round(list_sum(list_transform(l, lambda v, i: v * pow(0.5, len(l) - i)))
       / list_sum(list_transform(l, lambda v, i: pow(0.5, len(l) - i))), 6) AS ewm
FROM (SELECT windpark, time, list(wind_speed_10m) OVER (PARTITION BY windpark ORDER BY time ROWS BETWEEN 63 PRECEDING AND CURRENT ROW) AS l FROM v_nowcast)""")
def _(lab):
    smooth = series.ewm_mean(lab.nowcast, ["windpark"], "time", {"ewm": "wind_speed_10m"}, 0.5)
    return smooth.select("windpark", "time", r6("ewm").alias("ewm"))


SPANS = (3, 6, 12, 24)


@check("win_ewm_span", "SELECT bidding_area, time, " + ", ".join(
    f"round(list_sum(list_transform(l, lambda v, i: v * pow(1 - 2 / {s + 1}, len(l) - i))) / list_sum(list_transform(l, lambda v, i: pow(1 - 2 / {s + 1}, len(l) - i))), 6) AS ewma_{s:02d}"
    for s in SPANS) + """
FROM (SELECT bidding_area, time, list(lag_01) FILTER (WHERE lag_01 IS NOT NULL) OVER (PARTITION BY bidding_area ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l
      FROM (SELECT *, lag(power) OVER (PARTITION BY bidding_area ORDER BY time) AS lag_01 FROM v_hourly))""")
def _(lab):
    placed = series.with_position(lab.hourly, ["bidding_area"], ["time"], series.month_of("time"))
    rows = series.frame_columns(placed, ["bidding_area"], lambda w: {"lag_01": F.lag("power").over(w)}, before=1)
    for s in SPANS:
        rows = series.ewm_mean(rows, ["bidding_area"], "time", {f"ewma_{s:02d}": "lag_01"}, series.ewm_span(s), pos="pos")
    return rows.select("bidding_area", "time", *[r6(f"ewma_{s:02d}").alias(f"ewma_{s:02d}") for s in SPANS])


@check("win_partition_mean", """
SELECT windpark, time, round(avg(wind_speed_10m) OVER (PARTITION BY windpark), 6) AS location_mean_ws FROM v_nowcast""")
def _(lab):
    return local.station_mean(lab.nowcast, "windpark", "wind_speed_10m").select(
        "windpark", "time", r6("location_mean_ws").alias("location_mean_ws")
    )


@check("win_expanding_mean", """
SELECT windpark, time, round(avg(wind_speed_10m) OVER (PARTITION BY windpark ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS location_mean_ws FROM v_nowcast""")
def _(lab):
    return series.expanding_mean(lab.nowcast, ["windpark"], "time", "wind_speed_10m", "location_mean_ws").select(
        "windpark", "time", r6("location_mean_ws").alias("location_mean_ws")
    )


@check("win_partition_median", """
SELECT time, bidding_area, round(median(power / local_power) OVER (PARTITION BY bidding_area), 6) AS median_ratio
FROM v_local_sum JOIN v_area_power USING (time, bidding_area)""")
def _(lab):
    pairs = summaries.local_against_area(lab.unit_power, lab.units, lab.area_power).withColumn(
        "ratio", ratio("power", "local_power")
    )
    medians = exact_quantiles(pairs, ["bidding_area"], "ratio", {"median_ratio": 0.5}).drop("n")
    return pairs.join(medians, "bidding_area").select("time", "bidding_area", r6("median_ratio").alias("median_ratio"))


@check("win_forward_fill", """
SELECT bidding_area, time_ref, time, round(last_value(y_pred IGNORE NULLS) OVER (PARTITION BY bidding_area ORDER BY time_ref, time
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS y_pred
FROM v_truth LEFT JOIN v_ensemble_mean USING (bidding_area, time_ref, time)""")
def _(lab):
    pairs = truth.with_prediction(
        truth.evaluation_set(lab.area_power), truth.ensemble_mean_prediction(lab.local_pred),
        ["bidding_area", "time_ref", "time"], fill=None,
    )
    filled = series.forward_fill(settle(pairs, "pairs"), ["bidding_area"], ["time_ref", "time"], ["y_pred"], series.month_of("time_ref"))
    return filled.select("bidding_area", "time_ref", "time", r6("y_pred").alias("y_pred"))


@check("win_first_per_key", """
SELECT windpark_statnet, min(windpark_nve) AS windpark_nve FROM v_lookup GROUP BY 1""")
def _(lab):
    return first_per_key(lab.lookup.select("windpark_statnet", "windpark_nve"), ["windpark_statnet"], ["windpark_nve"])


def geo_sites(lab):
    """Two sites per unit on the raster; every third unit has a second one without a start date."""
    key = F.col("windpark_nve_id")
    sites = lab.points.join(lab.units.select("windpark_nve_id", "windpark_nve", "production_start_date"), "windpark_nve_id")
    started = sites.select(F.col("windpark_nve").alias("site_name"), F.col("production_start_date").alias("started"), "x", "y")
    planned = sites.filter(key % 3 == 0).select(
        F.col("windpark_nve").alias("site_name"), F.lit(None).cast("timestamp").alias("started"), (F.col("x") + 1).alias("x"), "y"
    )
    return started.unionByName(planned)


@check("win_sort_dedup", """
SELECT windpark_nve_id, windpark_nve_id % 3 <> 0 AS has_start_date, CASE WHEN windpark_nve_id % 3 = 0 THEN x + 1 ELSE x END AS x, y FROM v_points""")
def _(lab):
    return unit_sites(geo_sites(lab), lab.lookup)


@check("win_gap_detect", """
SELECT time, hours_since_last FROM (
  SELECT time, CAST(date_diff('hour', lag(time) OVER (ORDER BY time), time) AS BIGINT) AS hours_since_last
  FROM (SELECT DISTINCT time FROM v_area_power)) WHERE hours_since_last > 6""")
def _(lab):
    return series.gaps(lab.area_power, "time", 6)


@check("win_block_bounds", """
SELECT start, coalesce(lead(start) OVER (ORDER BY start), TIMESTAMP '9999-01-01 00:00:00') AS stop FROM (
  SELECT min(time_ref) AS start FROM v_forecast_wide WHERE time_ref >= TIMESTAMP '1998-01-01 00:00:00' GROUP BY date_trunc('month', time_ref))""")
def _(lab):
    return backtest.block_bounds(backtest.month_starts(lab.forecast_wide, "ws10m_00", "1998-01-01"))


@check("win_shift_bounds", """
SELECT bidding_area, time, lag(time, 47) OVER w AS lookback_start, lead(time, 39) OVER w AS window_start, lead(time, 62) OVER w AS window_stop
FROM v_hourly WINDOW w AS (PARTITION BY bidding_area ORDER BY time)""")
def _(lab):
    bounds = series.series_columns(
        lab.hourly, ["bidding_area"], "time",
        lambda w: {
            "lookback_start": F.lag("time", 47).over(w), "window_start": F.lead("time", 39).over(w),
            "window_stop": F.lead("time", 62).over(w),
        },
        before=47, after=62,
    )
    return bounds.drop("power")
