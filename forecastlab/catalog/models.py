"""Backtests, models and bands (survey 2.10)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from forecastlab.catalog.aggregates import scored_pairs
from forecastlab.catalog.features import area_table
from forecastlab.catalog.registry import check
from forecastlab.catalog.rows import r6
from forecastlab.functions.errors import rmse
from forecastlab.functions.scalars import is_day_ahead, logit
from forecastlab.plans import area, backtest, bands, design, grams, local, logitnormal, moments, trees, truth
from forecastlab.session import cut_lineage, settle

FIRST = "1998-01-01"
SPLIT = "1999-01-01"
TARGET, WEIGHT = "local_relative_power", "operating_power_max"


def line():
    return [F.lit(1.0), F.col("ws10m")]


def rolling_line(lab):
    """Monthly expanding fits on member 0, weighted by capacity, applied to all members."""
    return moments.rolling_prediction(
        lab.local_rows, line(), TARGET, WEIGHT, FIRST, scale=WEIGHT, fit_on=lab.first_rows
    )


@check("bt_time_blocks", """
SELECT start, stop, (SELECT count(*) FROM v_local_row WHERE time_ref < start AND local_relative_power IS NOT NULL) AS n_train,
       (SELECT count(*) FROM v_local_row WHERE time_ref >= start AND time_ref < stop) AS n_pred,
       (SELECT max(time_ref) FROM v_local_row WHERE time_ref < start AND local_relative_power IS NOT NULL) AS last_train
FROM v_block""")
def _(lab):
    rows = settle(lab.local_rows.select("time_ref", TARGET), "block_rows")
    summary = backtest.block_summary(rows, TARGET, FIRST)
    bounds = backtest.block_bounds(backtest.month_starts(rows, TARGET, FIRST))
    return bounds.join(summary, "start").select("start", "stop", "n_train", "n_pred", "last_train")


@check("bt_rolling_predict", "SELECT time_ref, time, bidding_area, round(y_pred, 5) AS y_pred FROM v_rolling")
def _(lab):
    return truth.ensemble_mean_prediction(rolling_line(lab)).withColumn("y_pred", F.round("y_pred", 5))


@check("bt_leak_guard", """
SELECT 'split' AS name, (SELECT max(time_ref) FROM v_local_row WHERE time_ref < TIMESTAMP '1999-01-01 00:00:00') AS last_train,
       (SELECT min(time_ref) FROM v_local_row WHERE time_ref >= TIMESTAMP '1999-01-01 00:00:00') AS first_pred, false AS leak
UNION ALL
SELECT 'all', (SELECT max(time_ref) FROM v_local_row), (SELECT min(time_ref) FROM v_local_row), true""")
def _(lab):
    early = F.col("time_ref") < F.lit(SPLIT).cast("timestamp")
    rows = settle(lab.local_rows.select("time_ref"), "issues")
    good = backtest.leak_check(rows.filter(early), rows.filter(~early)).withColumn("name", F.lit("split"))
    return good.unionByName(backtest.leak_check(rows, rows).withColumn("name", F.lit("all")))


@check("bt_holdout_split", """
SELECT windpark, time_ref, time, em, CASE WHEN time_ref < TIMESTAMP '1999-01-01 00:00:00' THEN 'train' ELSE 'validation' END AS part,
       operating_power_max AS sample_weight
FROM v_local_row WHERE local_relative_power IS NOT NULL AND lt > 0
  AND ((time_ref < TIMESTAMP '1999-01-01 00:00:00' AND em = 0)
    OR (time_ref >= TIMESTAMP '1999-01-01 00:00:00' AND CAST(time AS DATE) = CAST(time_ref + INTERVAL '2' DAY AS DATE)))""")
def _(lab):
    train, validation = backtest.holdout(lab.local_rows, SPLIT, TARGET, WEIGHT)
    both = train.withColumn("part", F.lit("train")).unionByName(validation.withColumn("part", F.lit("validation")))
    return both.select("windpark", "time_ref", "time", "em", "part", "sample_weight")


@check("bt_purged_split", """
SELECT bidding_area, time_ref, time, CASE WHEN pos < floor(n * 0.75) THEN 'train' WHEN pos < floor(n * 0.75) + 62 THEN 'gap' ELSE 'validation' END AS part
FROM (SELECT *, row_number() OVER (ORDER BY time_ref, time, bidding_area) - 1 AS pos, count(*) OVER () AS n FROM v_truth)""")
def _(lab):
    pairs = truth.evaluation_set(lab.area_power).select("bidding_area", "time_ref", "time")
    return backtest.purged_split(pairs, ["time_ref", "time", "bidding_area"], 0.75, 39 + 24 - 1)


@check("bt_train_year", """
WITH cutoff AS (SELECT min(time_ref) AS c FROM v_truth WHERE time_ref >= TIMESTAMP '2000-01-01 00:00:00')
SELECT bidding_area, time_ref, time, round(relative_power, 6) AS relative_power FROM v_area_dataset, cutoff
WHERE time_ref < c AND time_ref >= c - INTERVAL '365' DAY AND relative_power IS NOT NULL""")
def _(lab):
    late = truth.evaluation_set(lab.area_power, start="2000-01-01")
    year = backtest.train_year(area_table(lab), late, "relative_power")
    return year.select("bidding_area", "time_ref", "time", r6("relative_power").alias("relative_power"))


@check("mdl_linear_moments", """
SELECT start AS block, n, round(intercept, 5) AS intercept, round(slope, 6) AS slope FROM v_block_fit""")
def _(lab):
    fits = moments.expanding_coefficients(lab.first_rows, line(), TARGET, WEIGHT, FIRST)
    return fits.select(
        "block", "n", F.round(F.col("beta")[0], 5).alias("intercept"), r6(F.col("beta")[1]).alias("slope")
    )


#: SQL: the fit of a target on two features from sums named by their factors.
def plane(source: str, keys: str) -> str:
    return f"""SELECT {keys}, b, c, (sy - b * sx - c * sz) / sw AS a FROM (
  SELECT *, (cxy * czz - czy * cxz) / (cxx * czz - cxz * cxz) AS b, (czy * cxx - cxy * cxz) / (cxx * czz - cxz * cxz) AS c FROM (
    SELECT *, sxx - sx * sx / sw AS cxx, szz - sz * sz / sw AS czz, sxz - sx * sz / sw AS cxz, sxy - sx * sy / sw AS cxy, szy - sz * sy / sw AS czy
    FROM {source}))"""


PLANE_SUMS = ("sum(w) AS sw, sum(w * x) AS sx, sum(w * z) AS sz, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * z) AS sxz, "
              "sum(w * z * z) AS szz, sum(w * x * y) AS sxy, sum(w * z * y) AS szy")


def plane_terms():
    return [F.lit(1.0), F.col("ws10m"), F.col("t2m")]


@check("mdl_linear_plane", f"""
WITH d AS (SELECT time_ref, operating_power_max AS w, ws10m AS x, t2m AS z, local_relative_power AS y FROM v_local_row
           WHERE em = 0 AND local_relative_power IS NOT NULL AND ws10m IS NOT NULL AND t2m IS NOT NULL),
s AS (SELECT start, count(*) AS n, {PLANE_SUMS} FROM v_block JOIN d ON time_ref < start GROUP BY 1)
SELECT start AS block, n, round(a, 5) AS intercept, round(b, 6) AS speed, round(c, 6) AS warmth FROM ({plane("s", "start, n")})""")
def _(lab):
    fits = grams.expanding_coefficients(lab.first_rows, plane_terms(), TARGET, WEIGHT, FIRST).filter(F.col("beta").isNotNull())
    return fits.select(
        "block", "n", F.round(F.col("beta")[0], 5).alias("intercept"), r6(F.col("beta")[1]).alias("speed"), r6(F.col("beta")[2]).alias("warmth")
    )


def tree_score(predicted, pred: str = "local_power_pred", scale: bool = True):
    y = F.col(TARGET) * F.col(WEIGHT) if scale else F.col(TARGET)
    return predicted.groupBy("bidding_area").agg(
        F.count(F.lit(1)).alias("n"), rmse(y, pred).alias("rmse"), F.avg(pred).alias("mean_pred")
    )


TREE_HOLDOUT = "1998-07-01"


def full_split(lab):
    """The local table with all features, known targets only: training, holdout for the number of trees, later rows."""
    return early_held_late(known_table(lab))


def local_table(lab):
    return lab.local_table


def known_table(lab, used=None):
    """The table with known targets, written: all rows, or those that are used."""
    known = local_table(lab).filter(F.col(TARGET).isNotNull())
    return settle(known if used is None else known.filter(used), "local_table")


def early_held_late(table):
    hold, cut = (F.lit(day).cast("timestamp") for day in (TREE_HOLDOUT, SPLIT))
    at = F.col("time_ref")
    return table.filter(at < hold), table.filter((at >= hold) & (at < cut)), table.filter(at >= cut)


def first_split(lab):
    """The same for models of member 0: what they don't learn from, or predict, is not written."""
    return early_held_late(known_table(lab, (F.col("em") == 0) | (F.col("time_ref") >= F.lit(SPLIT).cast("timestamp"))))


def full_model(lab):
    train, held, later = first_split(lab)
    return trees.first_member_model(train, later, local.LOCAL_FEATURES, TARGET, WEIGHT, held)


ROLLING_HOLDOUT = "1997-07-01"
ROLLING = replace(trees.UNIT, eta=0.3, depth=5)


def member_table(lab):
    """Rows of all members with all features, targets known or not. Cells without a forecast are no member's and can't be summed by member."""
    return local_table(lab).filter(F.col("em").isNotNull())


def rolling_table(lab):
    """The same, written, for models that read it more than once."""
    return settle(member_table(lab), "rolling_table")


def known_rows(table):
    """The rows of the table that models learn from, written, with the columns they read and no others."""
    return settle(table.filter(F.col(TARGET).isNotNull()).select("time_ref", "em", TARGET, WEIGHT, *[F.col(f"`{c}`") for c in local.LOCAL_FEATURES]), "tree_rows")


def rolling_trees(table, pooled: bool = False, known=None, keep: bool = False):
    """Full-width trees through the monthly blocks, in the unit of the capacity: weighted on member 0, or unweighted on all members.

    The number of trees is settled once, by early stopping on the last half year before the first block; the models of all blocks are then
    grown together, each on all rows before its block. Only the rows that are learnt from are written (``known``, if not given); the predicted rows are read as
    they are made. ``keep``: rows before the first block stay, without a prediction.
    """
    own = lambda rows: rows if pooled else rows.filter(F.col("em") == 0)
    known = known_rows(own(table)) if known is None else own(known)
    weight, at = None if pooled else WEIGHT, F.col("time_ref")
    hold, first = (F.lit(day).cast("timestamp") for day in (ROLLING_HOLDOUT, FIRST))
    early = trees.grow(known.filter(at < hold), local.LOCAL_FEATURES, TARGET, [trees.Job("early", ROLLING)], weight, known.filter((at >= hold) & (at < first)))
    params = replace(ROLLING, rounds=max(1, early[0].n_trees)) if early[0].history else replace(ROLLING, rounds=ROLLING.patience)
    return trees.monthly_models(table, known, local.LOCAL_FEATURES, TARGET, FIRST, weight, params, WEIGHT, keep)[0]


RIDGE = 1.0
NOW_FEATURES = [c for c in local.LOCAL_FEATURES if c.startswith("now_") or c == "location_mean_ws"]
AIR_FEATURES = local.LOCAL_FEATURES[local.LOCAL_FEATURES.index("ws10m"):]


def ridge_table(table):
    """The table with a column per term of the line and the names of these: an intercept, all features, and what is missing. Nothing is written.

    Where an entry of the nowcast, the weather or the others is missing, that group counts as 0 and a term of its own says so.
    """
    others = [c for c in local.LOCAL_FEATURES if c not in NOW_FEATURES + AIR_FEATURES]
    terms = [F.lit(1.0)]
    for group in (others, NOW_FEATURES, AIR_FEATURES):
        numbers = [F.col(f"`{c}`").cast("double") for c in group]
        gap = F.array_contains(F.transform(F.array(*numbers), lambda v: v.isNull() | F.isnan(v)), True)
        terms += [F.when(gap, 0.0).otherwise(v) for v in numbers] + [gap.cast("double")]
    names = [f"x_{i}" for i in range(len(terms))]
    return table.withColumns(dict(zip(names, terms))), names


def rolling_ridge(table, known=None, keep: bool = False):
    """Monthly expanding ridge fits of all features on member 0, weighted by capacity, applied to all members.

    Only the rows that are fitted on (of ``known``, if given) are written, with the terms alone; the predicted rows are read once, as they are made.
    ``keep``: rows before the first block stay, without a prediction.
    """
    rows, names = ridge_table(table)
    fitted = (rows if known is None else ridge_table(known)[0]).filter((F.col("em") == 0) & F.col(TARGET).isNotNull()).select("time_ref", TARGET, WEIGHT, *names)
    return grams.rolling_prediction(
        rows, [F.col(c) for c in names], TARGET, WEIGHT, FIRST, ridge=RIDGE, scale=WEIGHT, fit_on=settle(fitted, "ridge_rows"), keep=keep
    )


def rolled_sums(lab):
    """Predictions of the pooled trees, the trees of member 0 and the ridge line, added up by area and member: all from one pass over the table's rows."""
    table = member_table(lab)
    known = known_rows(table)
    rows = rolling_trees(table, pooled=True, known=known, keep=True).withColumnRenamed("local_power_pred", "pooled")
    rows = rolling_trees(rows, known=known, keep=True).withColumnRenamed("local_power_pred", "first")
    rows = rolling_ridge(rows, known, keep=True).withColumnRenamed("local_power_pred", "ridge")
    sums = rows.groupBy("time_ref", "time", "bidding_area", "em").agg(*[F.sum(name).alias(name) for name in ("pooled", "first", "ridge")])
    return settle(sums, "rolled_sums")


@check("bt_rolling_trees")
def _(lab):
    return truth.ensemble_mean_prediction(rolling_trees(member_table(lab))).withColumn("y_pred", F.round("y_pred", 5))


@check("bt_rolling_ridge")
def _(lab):
    return truth.ensemble_mean_prediction(rolling_ridge(member_table(lab))).withColumn("y_pred", F.round("y_pred", 5))


@check("mdl_boosted_em0")
def _(lab):
    predicted, model = full_model(lab)
    return tree_score(predicted).withColumn("n_trees", F.lit(model.n_trees))


@check("mdl_boosted_facts", """
SELECT bidding_area, em, count(*) AS n, count(DISTINCT (time_ref, time, windpark)) AS n_keys, 0::BIGINT AS n_missing
FROM v_local_row WHERE local_relative_power IS NOT NULL AND time_ref >= TIMESTAMP '1999-01-01 00:00:00' GROUP BY 1, 2""")
def _(lab):
    # What SQL can say of the full model: every later row with a forecast has one prediction.
    predicted, _ = full_model(lab)
    return predicted.filter(F.col("em").isNotNull()).groupBy("bidding_area", "em").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("time_ref", "time", "windpark").alias("n_keys"),
        F.count_if(F.col("local_power_pred").isNull()).alias("n_missing"),
    )


@check("mdl_one_split", """
WITH known AS (SELECT lt, local_relative_power AS y FROM v_local_row WHERE em = 0 AND local_relative_power IS NOT NULL),
cuts AS (SELECT DISTINCT lt AS cut FROM known),
sides AS (SELECT cut, avg(y) FILTER (WHERE lt <= cut) AS low, avg(y) FILTER (WHERE lt > cut) AS high,
                 var_pop(y) FILTER (WHERE lt <= cut) * count(*) FILTER (WHERE lt <= cut) + var_pop(y) FILTER (WHERE lt > cut) * count(*) FILTER (WHERE lt > cut) AS sse
          FROM known, cuts GROUP BY 1),
best AS (SELECT * FROM sides WHERE sse IS NOT NULL ORDER BY sse, cut LIMIT 1)
SELECT DISTINCT lt, round(CASE WHEN lt <= cut THEN low ELSE high END, 6) AS pred FROM known, best""")
def _(lab):
    # One tree of depth one: the split and both leaf means can be worked out by hand.
    rows = lab.first_rows.filter(F.col(TARGET).isNotNull())
    model = trees.fit_trees(rows, ["lt"], TARGET, maxIter=1, maxDepth=1, maxBins=256)
    return trees.predict_trees(model, rows, ["lt"], name="pred").select("lt", r6("pred").alias("pred")).distinct()


@check("mdl_boosted_pooled")
def _(lab):
    train, held, later = full_split(lab)
    predicted, model = trees.pooled_model(train, later, local.LOCAL_FEATURES, TARGET, held)
    return tree_score(predicted, scale=False).withColumn("n_trees", F.lit(model.n_trees))


@check("mdl_boosted_per_member")
def _(lab):
    train, held, later = full_split(lab)
    predicted, models = trees.member_models(train, later, local.LOCAL_FEATURES, TARGET, validation=held)
    return tree_score(predicted, scale=False).withColumn("n_trees", F.lit(sum(m.n_trees for m in models)))


AREA_TREE = [*area.AREA_FEATURES, "mean_sum_pred", "min_sum_pred", "max_sum_pred"]


@check("mdl_boosted_area")
def _(lab):
    train, held, later = early_held_late(cut_lineage(area_table(lab).filter(F.col("relative_power").isNotNull())))
    model = trees.grow(train, AREA_TREE, "relative_power", [trees.Job("area", trees.UNIT)], "operating_power_max", held)[0]
    predicted = trees.predict([model], later, "area_pred", scale="operating_power_max")
    return predicted.groupBy("bidding_area").agg(
        rmse(F.col("mean_sum_pred") * F.col("operating_power_max"), "power").alias("rmse_sum_local"),
        rmse("area_pred", "power").alias("rmse_area"),
        F.lit(model.n_trees).alias("n_trees"),
    )


@check("mdl_importance")
def _(lab):
    first = F.col("em") == 0
    train, held, _ = early_held_late(known_table(lab, first & (F.col("time_ref") < F.lit(SPLIT).cast("timestamp"))))
    model = trees.grow(train.filter(first), local.LOCAL_FEATURES, TARGET, [trees.Job("em0", trees.UNIT)], WEIGHT, held.filter(first))[0]
    return lab.spark.createDataFrame(model.importance(), "feature string, importance double")


TRIALS = trees.random_trials(base=replace(trees.UNIT, eta=0.3))


@check("mdl_tune")
def _(lab):
    train, validation = backtest.holdout(known_table(lab), SPLIT, TARGET, WEIGHT)
    train, validation = settle(train, "tune_train"), settle(validation, "tune_held")
    trials, _ = trees.tune(train, validation, local.LOCAL_FEATURES, TARGET, WEIGHT, TRIALS, "unit_trees")
    return trials.select("study", "trial", *[F.col("params")[name].alias(name) for name in trees.TUNED], "n_trees", "rmse")


@check("mdl_quantile_band", """
SELECT bidding_area, time_ref, time, lt, round(greatest(y_pred + low, 0), 6) AS q05, round(y_pred + high, 6) AS q95
FROM v_scored LEFT JOIN (
  SELECT lt, quantile_cont(y_true - y_pred, 0.05) AS low, quantile_cont(y_true - y_pred, 0.95) AS high
  FROM v_scored WHERE time_ref < TIMESTAMP '1999-01-01 00:00:00' GROUP BY 1) USING (lt)
WHERE time_ref >= TIMESTAMP '1999-01-01 00:00:00'""")
def _(lab):
    pairs, cut = settle(scored_pairs(lab), "pairs"), F.lit(SPLIT).cast("timestamp")
    band = bands.quantile_band(pairs.filter(F.col("time_ref") >= cut), pairs.filter(F.col("time_ref") < cut), ["lt"])
    return band.select("bidding_area", "time_ref", "time", "lt", r6("q05").alias("q05"), r6("q95").alias("q95"))


@check("mdl_normal_band", """
SELECT bidding_area, time_ref, time, round(m - 1.96 * s, 6) AS lower, round(m + 1.96 * s, 6) AS upper, round(m - power, 6) AS residual
FROM (SELECT time_ref, time, bidding_area, avg(sum_local_pred) AS m, stddev_samp(sum_local_pred) AS s FROM v_member_sum GROUP BY 1, 2, 3)
JOIN v_area_power USING (time, bidding_area)""")
def _(lab):
    sums = area.ensemble_sums(lab.local_pred_wide).join(lab.area_power, ["time", "bidding_area"])
    band = bands.normal_band(sums)
    return band.select("bidding_area", "time_ref", "time", *[r6(c).alias(c) for c in ("lower", "upper", "residual")])


FILLED = [*design.MEAN_COLUMNS, *design.SPREAD_COLUMNS, "operating_power_max"]


def area_fit(lab):
    """Design of the training year, the parameters fitted to it, the asked rows and the day-ahead table."""
    asked = truth.evaluation_set(lab.area_power, start=SPLIT)
    table = settle(area_table(lab).filter(is_day_ahead("time", "time_ref")), "day_ahead")
    train = design.filled(backtest.train_year(table, asked, "relative_power"), FILLED)
    train = settle(design.with_design(train, ["bidding_area", "relative_power"]), "area_design")
    return train, logitnormal.fit(train, len(design.mean_design()), len(design.spread_design())), asked, table


def calibrated(lab, draws: int = 200):
    """Area model fitted on the year before the evaluation set, with draws for every row of that set.

    Missing entries take the last ones of their area, in training and evaluation alike. What is missing even then has no draws.
    """
    _, params, asked, table = area_fit(lab)
    known = table.select("bidding_area", "time_ref", "time", *FILLED)
    rows = design.filled(asked.join(known, ["bidding_area", "time_ref", "time"], "left"), FILLED)
    rows = design.with_design(rows, ["bidding_area", "time_ref", "time", "y_true", "operating_power_max"])
    return params, logitnormal.predict(rows, params, draws=draws)


@check("mdl_logit_normal")
def _(lab):
    params, _ = calibrated(lab)
    return params.select("bidding_area", "n", F.inline(F.arrays_zip("beta", F.sequence(F.lit(0), F.size("beta") - 1).alias("column")))).select(
        "bidding_area", "n", F.col("column").alias("column"), r6("beta").alias("beta")
    )


GRADIENT_ROWS = " AND ".join(f"count({c}) OVER w > 0" for c in FILLED[:-1])


@check("mdl_logit_normal_slope", f"""
WITH cut AS (SELECT min(time_ref) AS c FROM v_truth WHERE time_ref >= TIMESTAMP '{SPLIT} 00:00:00'),
train AS (SELECT bidding_area, {GRADIENT_ROWS} AS whole FROM v_area_dataset, cut
  WHERE CAST(time AS DATE) = CAST(time_ref + INTERVAL '2' DAY AS DATE) AND time_ref < c AND time_ref >= c - INTERVAL '365' DAY AND relative_power IS NOT NULL
  WINDOW w AS (PARTITION BY bidding_area ORDER BY time_ref, time ROWS UNBOUNDED PRECEDING)),
fitted AS (SELECT bidding_area, count(*) AS n FROM train WHERE whole GROUP BY 1)
SELECT bidding_area, n, k AS "column", 0::DOUBLE AS slope FROM fitted, (SELECT unnest(range(0, {len(design.MEAN_COLUMNS) + 9}))::INTEGER AS k)""")
def _(lab):
    # At the mode the gradient of the penalised likelihood is 0 in every column of both designs, on all rows that were trained on.
    train, params = area_fit(lab)[:2]
    slope = logitnormal.gradient(train, params)
    return slope.select("bidding_area", "n", "column", (F.round("slope", 3) + 0.0).alias("slope"))


DRAWS = 99
DRAW_LIST = "[" + ", ".join(f"{z!r}" + ("" if "e" in repr(z) else "e0") for z in logitnormal.normal_scores(DRAWS)) + "]"


@check("mdl_predictive_draws", f"""
WITH fitted AS (
  SELECT bidding_area, regr_slope(z, x) AS b, regr_intercept(z, x) AS a, regr_count(z, x) AS n,
         sqrt((regr_syy(z, x) - regr_slope(z, x) * regr_sxy(z, x)) / regr_count(z, x)) AS s
  FROM (SELECT bidding_area, mean_sum_pred AS x, ln(p / (1 - p)) AS z FROM (
    SELECT *, least(greatest(relative_power, 0.0001), 0.9999) AS p FROM v_area_dataset)) GROUP BY 1),
draws AS (
  SELECT d.bidding_area, d.time_ref, d.time,
         list_sort(list_transform({DRAW_LIST}, lambda e: operating_power_max / (1 + exp(-(a + b * mean_sum_pred + s * e))))) AS l
  FROM v_area_dataset d JOIN fitted USING (bidding_area) WHERE n >= 10)
SELECT bidding_area, time_ref, time, round(l[5] + (l[6] - l[5]) * 0.9, 5) AS q050, round(l[50], 5) AS q500,
       round(l[94] + (l[95] - l[94]) * 0.1, 5) AS q950, round(list_avg(l), 5) AS pred_mean, round(list_stddev_samp(l), 5) AS pred_std
FROM draws""")
def _(lab):
    table = area_table(lab).select("bidding_area", "time_ref", "time", "mean_sum_pred", "operating_power_max", "relative_power")
    z, x = logit("relative_power"), F.col("mean_sum_pred")
    fitted = table.withColumn("_z", z).groupBy("bidding_area").agg(
        F.regr_slope("_z", "mean_sum_pred").alias("b"), F.regr_intercept("_z", "mean_sum_pred").alias("a"),
        F.sqrt((F.regr_syy("_z", "mean_sum_pred") - F.regr_slope("_z", "mean_sum_pred") * F.regr_sxy("_z", "mean_sum_pred"))
               / F.regr_count("_z", "mean_sum_pred")).alias("s"),
        F.regr_count("_z", "mean_sum_pred").alias("n"),
    ).filter(F.col("n") >= 10)
    rows = table.join(fitted, "bidding_area")
    drawn = logitnormal.predictive_draws(rows, F.col("a") + F.col("b") * x, F.col("s"), "operating_power_max", DRAWS)
    columns = logitnormal.quantile_columns("draws", (0.05, 0.5, 0.95))
    return drawn.select("bidding_area", "time_ref", "time", *[F.round(c, 5).alias(n) for n, c in columns.items()])


@check("fn_ratio_adjust", """
WITH p AS (SELECT bidding_area, local_power, power, power / local_power AS r, ln(power) / nullif(ln(local_power), 0) AS l
           FROM v_local_sum JOIN v_area_power USING (time, bidding_area) WHERE local_power > 10 AND year(time) <= 2000),
m AS (SELECT bidding_area, median(r) AS mr, median(l) AS ml FROM p GROUP BY 1)
SELECT bidding_area, round(sqrt(avg((local_power * mr - power) * (local_power * mr - power))), 6) AS rmse_ratio,
       round(sqrt(avg((pow(local_power, ml) - power) * (pow(local_power, ml) - power))), 6) AS rmse_log
FROM p JOIN m USING (bidding_area) GROUP BY 1""")
def _(lab):
    from forecastlab.plans import summaries

    pairs = summaries.local_against_area(lab.unit_power, lab.units, lab.area_power).filter(
        (F.col("local_power") > 10) & (F.year("time") <= 2000)
    )
    adjusted = summaries.ratio_adjustment(pairs, "bidding_area")
    return adjusted.withColumns({c: r6(c) for c in ("rmse_ratio", "rmse_log")})
