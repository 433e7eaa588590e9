"""Baselines, scores and series statistics (survey 2.10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from forecastlab.catalog.aggregates import scored_pairs
from forecastlab.catalog.models import (
    FILLED, PLANE_SUMS, RIDGE, SPLIT, TARGET, WEIGHT, calibrated, line, member_table, plane, plane_terms, ridge_table, rolled_sums, rolling_line,
)
from forecastlab.catalog.registry import check
from forecastlab.catalog.rows import r6
from forecastlab.catalog.views import AR2_SOLUTION
from forecastlab.functions.ensemble import array_mean, array_quantile
from forecastlab.functions.errors import coverage
from forecastlab.functions.scalars import is_day_ahead
from forecastlab.operators.ranks import two_sample_ks
from forecastlab.plans import area, autoregression, baselines, grams, moments, scores, truth
from forecastlab.session import settle

AREA = ["bidding_area"]
SCORE = "round(sqrt(avg((y_true - y_pred) * (y_true - y_pred))), 5) AS rmse, round(avg(abs(y_true - y_pred)), 5) AS crps"

MOVING_SQL = """
SELECT t.*, m.y_pred FROM v_hour_truth t LEFT JOIN (
  SELECT bidding_area, time AS time_ref, CASE WHEN count(power) OVER w = 24 THEN avg(power) OVER w END AS y_pred FROM v_hourly
  WINDOW w AS (PARTITION BY bidding_area ORDER BY time ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)) m USING (bidding_area, time_ref)"""

AR2_PATH = """
WITH RECURSIVE path AS (
  SELECT bidding_area, time_ref, const, phi1, phi2, y AS now, y1 AS old, 0 AS h FROM v_ar2 WHERE det <> 0
  UNION ALL SELECT bidding_area, time_ref, const, phi1, phi2, const + phi1 * now + phi2 * old, now, h + 1 FROM path WHERE h < 63),
ar_pair AS (
  SELECT t.*, coalesce(p.now, 0) AS y_pred FROM v_hour_truth t LEFT JOIN (
    SELECT bidding_area, time_ref, CAST(h - 1 AS BIGINT) AS lt, now FROM path WHERE h >= 40) p USING (bidding_area, time_ref, lt))"""


def rounded_score(df):
    return df.withColumns({c: F.round(c, 5) for c in ("rmse", "crps")})


def hour_truth(lab):
    return truth.evaluation_set(lab.hourly)


@check("eval_truth_set", """
SELECT bidding_area, time_ref, time, lt, round(y_true, 6) AS y_true FROM v_hour_truth WHERE time_ref >= TIMESTAMP '2024-01-10 00:00:00'""")
def _(lab):
    return truth.evaluation_set(lab.hourly, start="2024-01-10").withColumn("y_true", r6("y_true"))


@check("base_moving_average", f"SELECT 'MA Baseline' AS name, {SCORE} FROM ({MOVING_SQL})")
def _(lab):
    return rounded_score(scores.point_score(baselines.moving_average(hour_truth(lab), lab.hourly), "MA Baseline"))


@check("base_ar2", f"{AR2_PATH} SELECT bidding_area, time_ref, time, lt, round(y_pred, 5) AS y_pred FROM ar_pair")
def _(lab):
    pairs = baselines.autoregressive(hour_truth(lab), lab.hourly)
    return pairs.select("bidding_area", "time_ref", "time", "lt", F.round("y_pred", 5).alias("y_pred"))


@check("base_single_model_mean", f"SELECT 'Single Model Mean' AS name, {SCORE} FROM v_scored")
def _(lab):
    return rounded_score(scores.point_score(scored_pairs(lab), "Single Model Mean"))


ROLLED = "(SELECT t.*, coalesce(p.y_pred, 0) AS y_pred FROM v_truth t LEFT JOIN v_rolling p USING (bidding_area, time_ref, time))"


@check("base_em0_model_mean", f"SELECT 'EM0 Model Mean' AS name, {SCORE} FROM {ROLLED}")
def _(lab):
    pairs = baselines.model_mean(truth.evaluation_set(lab.area_power), rolling_line(lab))
    return rounded_score(scores.point_score(pairs, "EM0 Model Mean"))


def member_draws(lab):
    """Area production beside the member sums as draws."""
    return area.ensemble_sums(lab.local_pred_wide).join(lab.area_power, ["time", "bidding_area"]).withColumnRenamed(
        "member_sums", "draws"
    )


CRPS_SQL = """
SELECT bidding_area, time_ref, time, lt, avg(abs(sum_local_pred - power)) - sum((2 * r - n - 1) * sum_local_pred) / (n * n) AS crps
FROM (SELECT m.*, p.power, row_number() OVER (PARTITION BY m.time_ref, m.time, m.bidding_area ORDER BY sum_local_pred) AS r,
             count(*) OVER (PARTITION BY m.time_ref, m.time, m.bidding_area) AS n
      FROM v_member_sum m JOIN v_area_power p USING (time, bidding_area))
GROUP BY bidding_area, time_ref, time, lt, n"""


@check("eval_crps", f"SELECT bidding_area, time_ref, time, lt, round(crps, 6) AS crps FROM ({CRPS_SQL})")
def _(lab):
    scored = scores.per_observation_crps(member_draws(lab), "power", "draws")
    return scored.select("bidding_area", "time_ref", "time", "lt", r6("crps").alias("crps"))


@check("eval_crps_weighted", f"""
SELECT bidding_area, round(sum(crps * lt) / sum(lt), 6) AS crps, round(avg(crps), 6) AS plain FROM ({CRPS_SQL}) GROUP BY 1""")
def _(lab):
    scored = scores.per_observation_crps(member_draws(lab), "power", "draws")
    return scored.groupBy("bidding_area").agg(
        r6(scores.mean_crps(weight="lt")).alias("crps"), r6(scores.mean_crps()).alias("plain")
    )


@check("eval_coverage", """
SELECT bidding_area, round(avg(CAST(power < lo AS INT)), 6) AS under, round(avg(CAST(power >= lo AND power <= hi AS INT)), 6) AS inside,
       round(avg(CAST(power > hi AS INT)), 6) AS over, round(avg(CAST(power > mid AS INT)), 6) AS over_median
FROM (SELECT time_ref, time, bidding_area, quantile_cont(sum_local_pred, 0.05) AS lo, quantile_cont(sum_local_pred, 0.5) AS mid,
             quantile_cont(sum_local_pred, 0.95) AS hi FROM v_member_sum GROUP BY 1, 2, 3)
JOIN v_area_power USING (time, bidding_area) GROUP BY 1""")
def _(lab):
    ordered = member_draws(lab).withColumn("draws", F.array_sort("draws"))
    bounds = {n: array_quantile(F.col("draws"), q) for n, q in (("lo", 0.05), ("mid", 0.5), ("hi", 0.95))}
    shares = ordered.withColumns(bounds).groupBy("bidding_area").agg(*coverage("power", "lo", "hi", "mid"))
    return shares.select("bidding_area", *[r6(c).alias(c) for c in ("under", "inside", "over", "over_median")])


REPORT_PATH = AR2_PATH.replace("v_ar2", "v_ar2_area").replace("v_hour_truth", "v_asked")
REPORT_MOVING = MOVING_SQL.replace("v_hour_truth", "v_asked").replace("v_hourly", "v_area_power")


def simple_models(lab, asked, single, em0):
    """Scores of the four models without calibration, all on the rows of ``asked``; the last two are of unit predictions."""
    return [
        scores.point_score(baselines.moving_average(asked, lab.area_power), "MA Baseline"),
        scores.point_score(baselines.autoregressive(asked, lab.area_power), "AR(2)"),
        scores.point_score(baselines.model_mean(asked, single), "Single Model Mean"),
        scores.point_score(baselines.model_mean(asked, em0), "EM0 Model Mean"),
    ]


@check("eval_report", f"""{REPORT_PATH}
SELECT 'MA Baseline' AS name, {SCORE} FROM ({REPORT_MOVING})
UNION ALL SELECT 'AR(2)', {SCORE} FROM ar_pair
UNION ALL SELECT 'Single Model Mean', {SCORE} FROM (SELECT t.*, coalesce(p.y_pred, 0) AS y_pred FROM v_asked t LEFT JOIN v_ensemble_mean p USING (bidding_area, time_ref, time))
UNION ALL SELECT 'EM0 Model Mean', {SCORE} FROM {ROLLED.replace("v_truth", "v_asked")}""")
def _(lab):
    # As the SQL says: the fixed curve and the line. eval_report_calibrated scores the trees.
    asked = truth.evaluation_set(lab.area_power, start=SPLIT)
    return rounded_score(scores.report(simple_models(lab, asked, lab.local_pred, rolling_line(lab))))


@check("eval_report_calibrated")
def _(lab):
    # All models on one truth set, units by full-width trees and the ridge line; these and the calibrator have no SQL beside them.
    asked, sums = truth.evaluation_set(lab.area_power, start=SPLIT), rolled_sums(lab)
    pooled, first, ridge = (sums.withColumn("local_power_pred", F.col(name)) for name in ("pooled", "first", "ridge"))
    models = simple_models(lab, asked, pooled, first)
    models.append(scores.point_score(baselines.model_mean(asked, ridge), "EM0 Ridge Mean"))
    _, drawn = calibrated(lab)
    drawn = drawn.withColumn("pred_mean", array_mean(F.col("draws")))
    return rounded_score(scores.report([*models, scores.draws_score(drawn, "Bayesian Calibrator")]))


@check("eval_calibrator")
def _(lab):
    _, drawn = calibrated(lab)
    drawn = drawn.withColumn("pred_mean", array_mean(F.col("draws")))
    return rounded_score(scores.draws_score(drawn, "Bayesian Calibrator"))


def seen(columns, frame):
    """SQL: whether every column has had a value in its area up to the row."""
    return " AND ".join(f"count({c}) OVER {frame} > 0" for c in columns)


@check("eval_calibrator_rows", f"""
WITH asked AS (SELECT * FROM v_truth WHERE time_ref >= TIMESTAMP '1999-01-01 00:00:00'),
cut AS (SELECT min(time_ref) AS c FROM asked),
data AS (SELECT * FROM v_area_dataset WHERE CAST(time AS DATE) = CAST(time_ref + INTERVAL '2' DAY AS DATE)),
fitted AS (SELECT DISTINCT bidding_area FROM (
  SELECT bidding_area, {seen(FILLED[:-1], "w")} AS whole FROM data, cut
  WHERE time_ref < c AND time_ref >= c - INTERVAL '365' DAY AND relative_power IS NOT NULL
  WINDOW w AS (PARTITION BY bidding_area ORDER BY time_ref, time ROWS UNBOUNDED PRECEDING)) WHERE whole),
val AS (SELECT bidding_area, {seen(FILLED, "w")} AS whole FROM asked LEFT JOIN data USING (bidding_area, time_ref, time)
  WINDOW w AS (PARTITION BY bidding_area ORDER BY time_ref, time ROWS UNBOUNDED PRECEDING))
SELECT bidding_area, count(*) AS n_truth, count(*) FILTER (whole AND bidding_area IN (SELECT bidding_area FROM fitted)) AS n_scored,
       count(*) FILTER (NOT (whole AND bidding_area IN (SELECT bidding_area FROM fitted))) AS n_missing FROM val GROUP BY 1""")
def _(lab):
    _, drawn = calibrated(lab, draws=3)
    return drawn.groupBy("bidding_area").agg(
        F.count(F.lit(1)).alias("n_truth"), F.count("draws").alias("n_scored"), F.count_if(F.col("draws").isNull()).alias("n_missing")
    )


def left_out(lab):
    """Errors of every unit when it is left out of the training, and when others are."""
    known = lab.local_rows.filter(F.col(TARGET).isNotNull())
    cut = F.lit(SPLIT).cast("timestamp")
    train = known.filter((F.col("time_ref") < cut) & (F.col("em") == 0))
    validation = known.filter((F.col("time_ref") >= cut) & is_day_ahead("time", "time_ref"))
    return moments.leave_one_out(train, validation, "windpark", line(), TARGET, WEIGHT)


@check("eval_loo_station", """
WITH known AS (SELECT * FROM v_local_row WHERE local_relative_power IS NOT NULL),
own AS (SELECT windpark, sum(w) AS sw, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy
        FROM (SELECT windpark, operating_power_max AS w, ws10m AS x, local_relative_power AS y FROM known
              WHERE time_ref < TIMESTAMP '1999-01-01 00:00:00' AND em = 0) GROUP BY 1),
total AS (SELECT sum(sw) AS sw, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy FROM own),
validation AS (SELECT windpark, operating_power_max AS weight, ws10m AS x, local_relative_power AS y FROM known
               WHERE time_ref >= TIMESTAMP '1999-01-01 00:00:00' AND CAST(time AS DATE) = CAST(time_ref + INTERVAL '2' DAY AS DATE)),
rest AS (SELECT u.windpark AS excluded, t.sw - coalesce(o.sw, 0) AS sw, t.sx - coalesce(o.sx, 0) AS sx, t.sy - coalesce(o.sy, 0) AS sy,
                t.sxx - coalesce(o.sxx, 0) AS sxx, t.sxy - coalesce(o.sxy, 0) AS sxy
         FROM (SELECT DISTINCT windpark FROM validation) u CROSS JOIN total t LEFT JOIN own o USING (windpark)),
fit AS (SELECT excluded, (sw * sxy - sx * sy) / (sw * sxx - sx * sx) AS b, (sy - (sw * sxy - sx * sy) / (sw * sxx - sx * sx) * sx) / sw AS a FROM rest),
error AS (SELECT windpark, weight, excluded, avg(pow(y - a - b * x, 2)) AS mse FROM validation, fit GROUP BY 1, 2, 3)
SELECT windpark, weight, true AS is_excluded, round(sqrt(mse), 5) AS rmse, round(sqrt(mse) * weight, 4) AS rmse_scaled
FROM error WHERE windpark = excluded
UNION ALL SELECT windpark, weight, false, round(sqrt(avg(mse)), 5), round(sqrt(avg(mse)) * weight, 4)
FROM error WHERE windpark <> excluded GROUP BY 1, 2""")
def _(lab):
    return left_out(lab).withColumns({"rmse": F.round("rmse", 5), "rmse_scaled": F.round("rmse_scaled", 4)})


def parts_of_split():
    """Conditions for known rows of member 0 before the split and for known day-ahead rows from it on."""
    known, cut = F.col(TARGET).isNotNull(), F.lit(SPLIT).cast("timestamp")
    return known & (F.col("time_ref") < cut) & (F.col("em") == 0), known & (F.col("time_ref") >= cut) & is_day_ahead("time", "time_ref")


def day_ahead_split(table):
    """Known rows of member 0 before the split to train on, day-ahead rows of all members from it on to score."""
    return tuple(table.filter(part) for part in parts_of_split())


@check("eval_loo_station_plane", f"""
WITH known AS (SELECT *, operating_power_max AS w, ws10m AS x, t2m AS z, local_relative_power AS y FROM v_local_row
               WHERE local_relative_power IS NOT NULL AND ws10m IS NOT NULL AND t2m IS NOT NULL),
train AS (SELECT * FROM known WHERE time_ref < TIMESTAMP '1999-01-01 00:00:00' AND em = 0),
validation AS (SELECT * FROM known WHERE time_ref >= TIMESTAMP '1999-01-01 00:00:00' AND CAST(time AS DATE) = CAST(time_ref + INTERVAL '2' DAY AS DATE)),
s AS (SELECT u.windpark AS excluded, {PLANE_SUMS} FROM (SELECT DISTINCT windpark FROM validation) u JOIN train t ON t.windpark <> u.windpark GROUP BY 1),
fit AS ({plane("s", "excluded")}),
error AS (SELECT windpark, w AS weight, excluded, avg(pow(y - a - b * x - c * z, 2)) AS mse FROM validation, fit GROUP BY 1, 2, 3)
SELECT windpark, weight, true AS is_excluded, round(sqrt(mse), 5) AS rmse, round(sqrt(mse) * weight, 4) AS rmse_scaled
FROM error WHERE windpark = excluded
UNION ALL SELECT windpark, weight, false, round(sqrt(avg(mse)), 5), round(sqrt(avg(mse)) * weight, 4)
FROM error WHERE windpark <> excluded GROUP BY 1, 2""")
def _(lab):
    train, validation = day_ahead_split(lab.local_rows)
    rows = grams.leave_one_out(train, validation, "windpark", plane_terms(), TARGET, WEIGHT)
    return rows.withColumns({"rmse": F.round("rmse", 5), "rmse_scaled": F.round("rmse_scaled", 4)})


@check("eval_loo_station_full")
def _(lab):
    """All 36 features and the terms for missing ones; refits of this are in the tests."""
    # The rows of both parts are written, with the terms alone, and nothing else of the table.
    whole, names = ridge_table(member_table(lab))
    training, scored = parts_of_split()
    used = whole.filter(training | scored).select("time_ref", "time", "em", "windpark", TARGET, WEIGHT, *names)
    train, validation = day_ahead_split(settle(used, "ridge_rows"))
    out = grams.leave_one_out(train, validation, "windpark", [F.col(c) for c in names], TARGET, WEIGHT, RIDGE)
    return out.withColumns({"rmse": F.round("rmse", 5), "rmse_scaled": F.round("rmse_scaled", 4)})


@check("eval_ks_two_sample", """
SELECT CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, round(ks, 6) AS ks,
       round(CASE WHEN ks * sqrt(n1 * n2 / (n1 + n2)) < 0.2 THEN 1 ELSE greatest(least(list_sum(list_transform(range(1, 101),
         lambda k: (CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END) * exp(-2.0 * k * k * ks * ks * n1 * n2 / (n1 + n2)))), 1), 0) END, 6) AS p_value
FROM (SELECT n1::DOUBLE AS n1, n2::DOUBLE AS n2, max(abs(c1 / n1 - c2 / n2)) AS ks
FROM (SELECT v, sum(a) OVER (ORDER BY v) AS c1, sum(b) OVER (ORDER BY v) AS c2, sum(a) OVER () AS n1, sum(b) OVER () AS n2
      FROM (SELECT l_extendedprice AS v, count(*) FILTER (WHERE l_returnflag = 'A') AS a, count(*) FILTER (WHERE l_returnflag = 'R') AS b
            FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1)) GROUP BY 1, 2)""")
def _(lab):
    rows = lab.table("lineitem").filter(F.col("l_returnflag").isin("A", "R"))
    return two_sample_ks(rows, "l_extendedprice", F.col("l_returnflag") == "A").select(
        "n1", "n2", r6("ks").alias("ks"), r6("p_value").alias("p_value")
    )


LAGS = list(range(39, 120))
CENTRED_SQL = "SELECT bidding_area, power - avg(power) OVER (PARTITION BY bidding_area) AS c, row_number() OVER (PARTITION BY bidding_area ORDER BY time) AS i FROM v_hourly"
ACF_SQL = f"""
SELECT a.bidding_area, k AS lag, sum(a.c * b.c) / any_value(v.s) AS r
FROM (SELECT *, unnest(generate_series(0, 119)) AS k FROM ({CENTRED_SQL})) a
JOIN ({CENTRED_SQL}) b ON a.bidding_area = b.bidding_area AND b.i = a.i + a.k
JOIN (SELECT bidding_area, sum(c * c) AS s FROM ({CENTRED_SQL}) GROUP BY 1) v ON v.bidding_area = a.bidding_area GROUP BY 1, 2"""


def acf(lab):
    return autoregression.autocorrelation(lab.hourly, AREA, "time", "power", 119)


@check("ts_acf", f"SELECT bidding_area, lag, round(r, 6) AS acf FROM ({ACF_SQL}) WHERE lag >= 39")
def _(lab):
    return autoregression.lag_rows(acf(lab), AREA, "acf", LAGS, "acf").withColumn("acf", r6("acf"))


@check("ts_pacf", f"""
WITH RECURSIVE r AS (SELECT bidding_area, list(r ORDER BY lag)[2:] AS l FROM ({ACF_SQL}) GROUP BY 1),
step AS (
  SELECT bidding_area, l, 1 AS k, l[1] AS last, [l[1]] AS phi FROM r
  UNION ALL
  SELECT bidding_area, l, k + 1, v, list_append(list_transform(phi, lambda p, i: p - v * phi[k + 1 - i]), v)
  FROM (SELECT *, (l[k + 1] - list_sum(list_transform(phi, lambda p, i: p * l[k + 1 - i])))
                  / (1 - list_sum(list_transform(phi, lambda p, i: p * l[i]))) AS v FROM step WHERE k < 119))
SELECT bidding_area, CAST(k AS BIGINT) AS lag, round(last, 5) AS pacf FROM step WHERE k >= 39""")
def _(lab):
    pacf = autoregression.partial_autocorrelation(acf(lab), AREA)
    return autoregression.lag_rows(pacf, AREA, "pacf", LAGS, "pacf").withColumn("pacf", F.round("pacf", 5))


@check("ts_adf_stat", """
SELECT bidding_area, CAST(n AS BIGINT) AS n, round(b / sqrt((syy - b * b * sxx) / (n - 2) / sxx), 5) AS statistic
FROM (SELECT bidding_area, regr_count(y - y1, y1) AS n, regr_slope(y - y1, y1) AS b, regr_sxx(y - y1, y1) AS sxx, regr_syy(y - y1, y1) AS syy
      FROM v_hour_lags GROUP BY 1)""")
def _(lab):
    return autoregression.dickey_fuller(lab.hourly, AREA, "time", "power").withColumn("statistic", F.round("statistic", 5))


@check("ts_adf_stat_aic")
def _(lab):
    return autoregression.augmented_dickey_fuller(lab.hourly, AREA, "time", "power").withColumns(
        {"statistic": F.round("statistic", 5), "p_value": F.round("p_value", 6)}
    )


@check("ts_ar_criteria", f"""
SELECT bidding_area, CAST(n AS BIGINT) AS n, round(const, 5) AS const, round(phi1, 5) AS phi1, round(phi2, 5) AS phi2,
       round(n * (ln(2 * pi()) + ln(ssr / n) + 1) + 8, 4) AS aic, round(n * (ln(2 * pi()) + ln(ssr / n) + 1) + 8 * ln(ln(n)), 4) AS hqic,
       round(n * (ln(2 * pi()) + ln(ssr / n) + 1) + 4 * ln(n), 4) AS bic
FROM ({AR2_SOLUTION.format(source='''(SELECT bidding_area, CAST(count(*) AS DOUBLE) AS n, sum(y1) AS s1, sum(y2) AS s2, sum(y) AS sy, sum(y1 * y1) AS s11,
      sum(y2 * y2) AS s22, sum(y1 * y2) AS s12, sum(y1 * y) AS s1y, sum(y2 * y) AS s2y, sum(y * y) AS syy
      FROM v_hour_lags WHERE y2 IS NOT NULL GROUP BY 1)''')})""")
def _(lab):
    fitted = autoregression.ar_criteria(lab.hourly, AREA, "time", "power")
    digits = {"const": 5, "phi1": 5, "phi2": 5, "aic": 4, "hqic": 4, "bic": 4}
    return fitted.withColumns({c: F.round(c, d) for c, d in digits.items()})
