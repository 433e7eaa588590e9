"""Aggregations (survey 2.4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from forecastlab.catalog.joins import area_cells, unit_cells
from forecastlab.catalog.registry import check
from forecastlab.catalog.rows import r6
from forecastlab.functions import ensemble, errors
from forecastlab.functions.scalars import last_chars, ratio
from forecastlab.operators.intervals import visible_totals
from forecastlab.operators.ranks import exact_quantiles
from forecastlab.plans import area, backtest, summaries, truth, units
from forecastlab.session import settle


def scored_pairs(lab):
    """Evaluation rows with the ensemble mean prediction, missing ones as 0."""
    return truth.with_prediction(
        truth.evaluation_set(lab.area_power), truth.ensemble_mean_prediction(lab.local_pred),
        ["bidding_area", "time_ref", "time"],
    )


@check("agg_sum_members", """
SELECT time_ref, time, lt, bidding_area, em, round(sum_local_pred, 6) AS sum_local_pred FROM v_member_sum""")
def _(lab):
    return area.member_sums(lab.local_pred).withColumn("sum_local_pred", r6("sum_local_pred"))


@check("agg_sum_then_mean", "SELECT time_ref, time, bidding_area, round(y_pred, 6) AS y_pred FROM v_ensemble_mean")
def _(lab):
    return truth.ensemble_mean_prediction(lab.local_pred).withColumn("y_pred", r6("y_pred"))


@check("agg_ensemble_stats", """
SELECT time_ref, time, lt, bidding_area, round(avg(sum_local_pred), 6) AS mean_sum_pred, round(stddev_samp(sum_local_pred), 6) AS std_sum_pred,
       round(min(sum_local_pred), 6) AS min_sum_pred, round(max(sum_local_pred), 6) AS max_sum_pred
FROM v_member_sum GROUP BY ALL""")
def _(lab):
    sums = F.col("member_sums")
    return area.ensemble_sums(lab.local_pred_wide).select(
        "time_ref", "time", "lt", "bidding_area",
        r6(ensemble.array_mean(sums)).alias("mean_sum_pred"), r6(ensemble.array_std(sums)).alias("std_sum_pred"),
        r6(F.array_min(sums)).alias("min_sum_pred"), r6(F.array_max(sums)).alias("max_sum_pred"),
    )


@check("agg_unavailable_ratio", """
SELECT windpark_nve_id, time_ref, time, unavailableCapacity, installedCapacity, round(unavailable_capacity, 6) AS unavailable_capacity
FROM v_unit_share""")
def _(lab):
    known = visible_totals(
        settle(unit_cells(lab), "cells"), lab.outages, ["windpark_nve_id"], ["unavailableCapacity", "installedCapacity"]
    )
    return known.withColumn("unavailable_capacity", r6(ratio("unavailableCapacity", "installedCapacity")))


@check("agg_transmission_ratio", """
SELECT bidding_area, time_ref, time, unplannedEvent, round(unavailable_transmission, 6) AS unavailable_transmission FROM v_area_share""")
def _(lab):
    rows = settle(area_cells(lab), "cells").withColumn("outAreaName", last_chars("bidding_area", 3))
    known = visible_totals(
        rows, lab.transmission, ["outAreaName"], ["unavailableCapacity", "installedCapacity"], ["unplannedEvent"]
    )
    return known.select(
        F.concat(F.lit("ELSPOT "), "outAreaName").alias("bidding_area"), "time_ref", "time", "unplannedEvent",
        r6(ratio("unavailableCapacity", "installedCapacity")).alias("unavailable_transmission"),
    )


@check("agg_max_by_unit", "SELECT windpark_nve_id, max(local_power) AS actual_max_output FROM v_unit_power GROUP BY 1")
def _(lab):
    return units.observed_maximum(lab.unit_power)


@check("agg_nested_sum_product", """
SELECT windpark_nve AS Navn, windpark_nve_id AS VindkraftAnleggId, operating_power_max AS InstallertEffekt_MW,
       round((kw_a * n_a + kw_b * n_b) / 1000, 6) AS sum_effect, max_output
FROM v_register LEFT JOIN (SELECT windpark_nve_id, max(local_power) AS max_output FROM v_unit_power GROUP BY 1) USING (windpark_nve_id)""")
def _(lab):
    return units.turbine_effect(lab.register, lab.unit_power).withColumn("sum_effect", r6("sum_effect"))


@check("agg_rmse_group", """
SELECT bidding_area, round(sqrt(avg((y_true - y_pred) * (y_true - y_pred))), 6) AS rmse, count(*) AS n FROM v_scored GROUP BY 1""")
def _(lab):
    return scored_pairs(lab).groupBy("bidding_area").agg(
        r6(errors.rmse("y_true", "y_pred")).alias("rmse"), F.count(F.lit(1)).alias("n")
    )


@check("agg_rmse_weighted", """
SELECT bidding_area, round(sqrt(sum(lt * (y_true - y_pred) * (y_true - y_pred)) / sum(lt)), 6) AS rmse FROM v_scored GROUP BY 1""")
def _(lab):
    return scored_pairs(lab).groupBy("bidding_area").agg(r6(errors.weighted_rmse("y_true", "y_pred", "lt")).alias("rmse"))


@check("agg_rmse_by_year", """
SELECT bidding_area, CAST(year(time) AS INT) AS year, round(sqrt(avg((local_power - power) * (local_power - power))), 6) AS rmse
FROM v_local_sum JOIN v_area_power USING (time, bidding_area) GROUP BY 1, 2""")
def _(lab):
    pairs = summaries.local_against_area(lab.unit_power, lab.units, lab.area_power)
    return pairs.groupBy("bidding_area", F.year("time").alias("year")).agg(
        r6(errors.rmse("local_power", "power")).alias("rmse")
    )


# Round quotients of small whole numbers often end in exactly half of the last digit, where the order
# of summation decides; the shift moves them off that edge on both sides.
OFF_EDGE = 1e-8


@check("agg_weighted_mean", """
SELECT bidding_area, time_ref, time, round(1e-8 + sum(rh2m_00 * operating_power_max) / sum(operating_power_max), 6) AS rh2m, """
       + ", ".join(f"round(1e-8 + sum(ws10m_{em:02d} * operating_power_max) / sum(operating_power_max), 6) AS ws10m_{em:02d}" for em in range(15))
       + " FROM v_forecast_wide JOIN v_units ON sid = windpark_statnet GROUP BY 1, 2, 3")
def _(lab):
    rows = lab.forecast_wide.join(
        lab.units.select(F.col("windpark_statnet").alias("sid"), "bidding_area", "operating_power_max"), "sid"
    )
    members = [f"ws10m_{em:02d}" for em in range(15)]
    means = rows.groupBy("bidding_area", "time_ref", "time").agg(
        errors.weighted_mean("rh2m_00", "operating_power_max").alias("rh2m"),
        *[errors.weighted_mean(m, "operating_power_max").alias(m) for m in members],
    )
    return means.withColumns({c: r6(OFF_EDGE + F.col(c)) for c in ["rh2m", *members]})


@check("agg_daily_mse_top", """
SELECT windpark, round(avg(mse), 6) AS mse FROM (
  SELECT windpark, CAST(time AS DATE) AS day, avg((p.local_power_pred - u.local_power) * (p.local_power_pred - u.local_power)) AS mse
  FROM v_local_pred p JOIN v_lookup l ON p.windpark = l.windpark_nve JOIN v_unit_power u USING (windpark_nve_id, time)
  GROUP BY 1, 2 ORDER BY mse DESC, windpark, day LIMIT 100) GROUP BY 1""")
def _(lab):
    power = lab.unit_power.join(lab.lookup.select("windpark_nve_id", F.col("windpark_nve").alias("windpark")), "windpark_nve_id")
    error = F.col("local_power_pred") - F.col("local_power")
    pairs = lab.local_pred.join(power, ["windpark", "time"]).withColumn("sqerror", error * error)
    return summaries.worst_days(pairs, ["windpark"]).withColumn("mse", r6("mse"))


@check("agg_median_group", """
SELECT l_returnflag, count(*) AS n, round(median(l_extendedprice), 6) AS median_price FROM lineitem GROUP BY 1""")
def _(lab):
    medians = exact_quantiles(lab.table("lineitem"), ["l_returnflag"], "l_extendedprice", {"median_price": 0.5})
    return medians.withColumn("median_price", r6("median_price"))


@check("agg_two_group_contrast", """
SELECT round(avg(l_quantity) FILTER (WHERE l_returnflag = 'A') - avg(l_quantity) FILTER (WHERE l_returnflag = 'R'), 6) AS mean_l_quantity,
       round(avg(l_quantity) FILTER (WHERE l_returnflag = 'A') / avg(l_quantity) FILTER (WHERE l_returnflag = 'R'), 6) AS mean_l_quantity_pct,
       round(median(l_quantity) FILTER (WHERE l_returnflag = 'A') - median(l_quantity) FILTER (WHERE l_returnflag = 'R'), 6) AS median_l_quantity,
       round(median(l_quantity) FILTER (WHERE l_returnflag = 'A') / median(l_quantity) FILTER (WHERE l_returnflag = 'R'), 6) AS median_l_quantity_pct
FROM lineitem""")
def _(lab):
    flag = F.col("l_returnflag")
    first = F.when(flag == "A", True).when(flag == "R", False)
    contrast = summaries.two_group_contrast(lab.table("lineitem"), first, ["l_quantity"])
    return contrast.select(*[r6(c).alias(c) for c in contrast.columns])


@check("agg_distinct_rows", "SELECT DISTINCT time_ref, time FROM v_forecast_wide")
def _(lab):
    return lab.forecast_wide.select("time_ref", "time").distinct()


@check("agg_duplicated_keys", """
SELECT windpark_nve_id, windpark_statnet FROM v_units
WHERE windpark_statnet IN (SELECT windpark_statnet FROM v_units GROUP BY 1 HAVING count(*) > 1)""")
def _(lab):
    return summaries.duplicated_keys(lab.units.select("windpark_nve_id", "windpark_statnet"), ["windpark_statnet"])


@check("agg_month_first", """
SELECT date_trunc('month', time_ref) AS month, min(time_ref) AS start
FROM v_forecast_wide WHERE ws10m_00 > 1 AND time_ref >= TIMESTAMP '1998-01-01 00:00:00' GROUP BY 1""")
def _(lab):
    target = F.when(F.col("ws10m_00") > 1, F.col("ws10m_00"))
    return backtest.month_starts(lab.forecast_wide.select("time_ref", target.alias("y")), "y", "1998-01-01").withColumn(
        "month", F.col("month").cast("timestamp")
    )


@check("agg_scalar_bound", """
SELECT time, bidding_area, round(power, 6) AS power FROM v_area_power
WHERE time >= (SELECT max(time) FROM v_area_power) - INTERVAL '365' DAY""")
def _(lab):
    latest = lab.area_power.agg(F.max("time")).scalar()
    recent = F.col("time") >= F.timestamp_add("DAY", F.lit(-365), latest)
    return lab.area_power.filter(recent).select("time", "bidding_area", r6("power").alias("power"))


@check("agg_column_max_scale", """
SELECT time, bidding_area, round(power / max(power) OVER (PARTITION BY bidding_area), 6) AS scaled FROM v_area_power""")
def _(lab):
    scaled = summaries.column_max_scale(lab.area_power, ["bidding_area"], "power", "scaled")
    return scaled.select("time", "bidding_area", r6("scaled").alias("scaled"))


@check("agg_mean_ratio_scalars", """
SELECT round(avg(operating_power_max / num_turbines), 6) AS mw_per_turbine, round(avg(mean_production / operating_power_max), 6) AS gwh_per_mw
FROM v_units""")
def _(lab):
    return lab.units.agg(
        r6(F.avg(ratio("operating_power_max", "num_turbines"))).alias("mw_per_turbine"),
        r6(F.avg(ratio("mean_production", "operating_power_max"))).alias("gwh_per_mw"),
    )


@check("agg_bool_share", """
SELECT bidding_area, round(avg(CAST(y_true < 0.5 * y_pred AS INT)), 6) AS under, round(avg(CAST(y_true > 1.5 * y_pred AS INT)), 6) AS over
FROM v_scored GROUP BY 1""")
def _(lab):
    y, p = F.col("y_true"), F.col("y_pred")
    return scored_pairs(lab).groupBy("bidding_area").agg(
        r6(errors.share(y < 0.5 * p)).alias("under"), r6(errors.share(y > 1.5 * p)).alias("over")
    )


QUANTILES = {"q025": 0.025, "q050": 0.05, "q500": 0.5, "q950": 0.95, "q975": 0.975}


@check("agg_quantiles", "SELECT time_ref, time, lt, bidding_area, "
       + ", ".join(f"round(quantile_cont(sum_local_pred, {q}), 6) AS {n}" for n, q in QUANTILES.items())
       + ", round(avg(sum_local_pred), 6) AS pred_mean, round(stddev_samp(sum_local_pred), 6) AS pred_std FROM v_member_sum GROUP BY ALL")
def _(lab):
    ordered = area.ensemble_sums(lab.local_pred_wide).withColumn("draws", F.array_sort("member_sums"))
    draws = F.col("draws")
    return ordered.select(
        "time_ref", "time", "lt", "bidding_area",
        *[r6(ensemble.array_quantile(draws, q)).alias(n) for n, q in QUANTILES.items()],
        r6(ensemble.array_mean(draws)).alias("pred_mean"), r6(ensemble.array_std(draws)).alias("pred_std"),
    )


@check("agg_histogram", """
SELECT bidding_area, CAST(CASE WHEN high > low THEN least(floor((residual - low) / ((high - low) / 50)), 49) ELSE 0 END AS BIGINT) AS bin, count(*) AS n
FROM (SELECT bidding_area, residual, min(residual) OVER w AS low, max(residual) OVER w AS high
      FROM (SELECT bidding_area, round(y_pred - y_true, 6) AS residual FROM v_scored) WINDOW w AS (PARTITION BY bidding_area)) GROUP BY 1, 2""")
def _(lab):
    residual = scored_pairs(lab).select("bidding_area", r6(F.col("y_pred") - F.col("y_true")).alias("residual"))
    return summaries.histogram(residual, "bidding_area", "residual")


@check("agg_box_stats", """
SELECT l_linestatus AS label, count(*) AS n, round(quantile_cont(l_extendedprice, 0.25), 6) AS q1,
       round(quantile_cont(l_extendedprice, 0.5), 6) AS q2, round(quantile_cont(l_extendedprice, 0.75), 6) AS q3
FROM lineitem GROUP BY 1""")
def _(lab):
    labelled = lab.table("lineitem").withColumnRenamed("l_linestatus", "label")
    box = exact_quantiles(labelled, ["label"], "l_extendedprice", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    return box.select("label", "n", *[r6(q).alias(q) for q in ("q1", "q2", "q3")])


@check("agg_count_by_type", """
SELECT kind AS TurbinType, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT 'A' AS kind, n_a AS n FROM v_register UNION ALL SELECT 'B' || (windpark_nve_id % 3), n_b FROM v_register) GROUP BY 1""")
def _(lab):
    turbines = lab.register.select(F.inline("Turbiner"))
    return turbines.groupBy("TurbinType").agg(F.sum("AntallTurbiner").alias("n")).orderBy("n", "TurbinType")
