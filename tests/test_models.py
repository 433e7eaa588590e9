import math
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from forecastlab.functions import ensemble, errors, physics, scalars, seasons
from forecastlab.operators import ranks, reshape
from forecastlab.plans import area, autoregression, backtest, bands, boosting, logitnormal, moments, scores, trees


def panel(n=600, seed=1):
    rng = np.random.default_rng(seed)
    time_ref = pd.Timestamp("2023-01-01 09:00") + pd.to_timedelta(np.sort(rng.integers(0, 300, n)), "D")
    lt = rng.integers(39, 63, n)
    x1, x2 = rng.normal(size=n), rng.normal(size=n)
    unit = rng.integers(0, 6, n)
    weight = 10.0 + 5 * unit
    y = 0.3 + 0.5 * x1 - 0.2 * x2 + rng.normal(size=n) * 0.1
    y[rng.random(n) < 0.1] = np.nan
    return pd.DataFrame({
        "time_ref": time_ref, "time": time_ref + pd.to_timedelta(lt, "h"), "lt": lt, "em": rng.integers(0, 2, n),
        "windpark": [f"u{u}" for u in unit], "w": weight, "x1": x1, "x2": x2, "y": y,
    })


def to_spark(spark, frame):
    return spark.createDataFrame(frame).withColumn("y", F.when(~F.isnan("y"), F.col("y")))


def design():
    return [F.lit(1.0), F.col("x1"), F.col("x2")]


def solve(frame):
    a = np.column_stack([np.ones(len(frame)), frame["x1"], frame["x2"]]) * np.sqrt(frame["w"].to_numpy())[:, None]
    return np.linalg.lstsq(a, frame["y"].to_numpy() * np.sqrt(frame["w"].to_numpy()), rcond=None)[0]


def test_expanding_fits_equal_refits(spark):
    frame = panel()
    df = to_spark(spark, frame)
    got = moments.expanding_coefficients(df, design(), "y", "w", "2023-04-01").toPandas().sort_values("block")
    known = frame.dropna(subset=["y"])
    assert len(got) == known[known.time_ref >= "2023-04-01"].time_ref.dt.to_period("M").nunique()
    for _, row in got.iterrows():
        train = known[known.time_ref < row["block"]]
        assert row["n"] == len(train)
        np.testing.assert_allclose(row["beta"], solve(train), atol=1e-9)


def test_blocks_cover_prediction_rows_once(spark):
    frame = panel()
    df = to_spark(spark, frame)
    predicted = moments.rolling_prediction(df, design(), "y", "w", "2023-04-01")
    first = frame[(frame.time_ref >= "2023-04-01") & frame.y.notna()].time_ref.min()
    assert predicted.count() == (frame.time_ref >= first).sum()
    summary = backtest.block_summary(df, "y", "2023-04-01").toPandas()
    assert (summary["last_train"] < summary["first_pred"]).all()


def test_any_model_in_the_block_loop(spark):
    df = to_spark(spark, panel()).withColumn("em", F.lit(0))
    x = design()

    def fit(train):
        sums = train.agg(*moments.moment_sums(x, F.col("y"), F.col("w"))).withColumn("k", F.lit(1))
        return moments.solve(sums, ["k"], 3).first()["beta"]

    def predict(beta, rows):
        return rows.withColumn("pred", sum((b * c for b, c in zip(beta[1:], x[1:])), F.lit(beta[0])))

    keys = ["time_ref", "time", "windpark", "x1"]
    looped = backtest.rolling_models(df, "y", "2023-08-01", fit, predict).select(*keys, "pred").toPandas().sort_values(keys)
    summed = moments.rolling_prediction(df, x, "y", "w", "2023-08-01", name="pred").select(*keys, "pred").toPandas().sort_values(keys)
    np.testing.assert_allclose(looped["pred"], summed["pred"], atol=1e-9)
    seen = []
    grown = backtest.rolling_models(
        df, "y", "2023-09-01", lambda train: seen.append(train.count()) or trees.fit_trees(train, ["x1", "x2"], "y", maxIter=2, maxDepth=2),
        lambda model, rows: trees.predict_trees(model, rows, ["x1", "x2"], name="pred"),
    )
    assert grown.filter(F.col("pred").isNull()).isEmpty() and seen == sorted(seen) and len(seen) >= 2


def test_trees_stop_early(spark):
    df = to_spark(spark, panel())
    early = F.col("time_ref") < F.lit("2023-07-01").cast("timestamp")
    model = trees.fit_trees(df.filter(early), ["x1", "x2"], "y", None, df.filter(~early), maxIter=60, maxDepth=3, stepSize=0.3)
    assert 1 < model.stages[-1].getNumTrees < 60


def test_leave_one_out_equals_refits(spark):
    frame = panel().dropna(subset=["y"])
    train, val = frame[frame.time_ref < "2023-07-01"], frame[frame.time_ref >= "2023-07-01"]
    rows = moments.leave_one_out(spark.createDataFrame(train), spark.createDataFrame(val), "windpark", design(), "y", "w").toPandas()
    units = sorted(val.windpark.unique())
    assert len(rows) == 2 * len(units) and rows["is_excluded"].sum() == len(units)
    errors = {}
    for unit in units:
        part = val[val.windpark == unit]
        x = np.column_stack([np.ones(len(part)), part["x1"], part["x2"]])
        errors[unit] = {out: ((part["y"] - x @ solve(train[train.windpark != out])) ** 2).mean() for out in units}
    for _, row in rows.iterrows():
        mine = errors[row["windpark"]]
        want = mine[row["windpark"]] if row["is_excluded"] else np.mean([e for out, e in mine.items() if out != row["windpark"]])
        assert row["rmse"] == pytest.approx(math.sqrt(want), abs=1e-9)
        assert row["rmse_scaled"] == pytest.approx(row["rmse"] * row["weight"])


def test_features_of_different_size_are_not_dependent(spark):
    rng = np.random.default_rng(5)
    rows = [(float(1000 + 1e-3 * v), float(1e-6 * rng.normal()), float(v)) for v in rng.normal(size=400)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    sums = df.agg(*moments.moment_sums([F.lit(1.0), F.col("a") - 1000, F.col("b")], F.col("y"), F.lit(1.0))).withColumn("k", F.lit(1))
    assert moments.solve(sums, ["k"], 3).first()["beta"] is not None


def test_every_member_counts(spark):
    stamp = "timestamp'2024-01-01 00:00:00'"
    rows = spark.range(17 * 3).selectExpr(
        f"{stamp} as time_ref", f"{stamp} + interval 40 hours as time", "40L as lt", "'ELSPOT NO1' as bidding_area",
        "cast(id % 17 as int) as em", "cast(id as double) as local_power_pred",
    )
    row = area.ensemble_sums(rows).first()
    assert row["member_sums"] == [float(3 * em + 51) for em in range(17)]


def test_members_side_by_side_have_the_same_sums(spark):
    """Members in columns give the sums of members in rows, without a row per member; one without any value does not occur."""
    from forecastlab.operators.reshape import ensemble_long

    at = ["timestamp'2024-01-01 00:00:00' as time_ref", "timestamp'2024-01-02 16:00:00' as time", "40L as lt", "concat('ELSPOT NO', cast(id % 3 as string)) as bidding_area"]
    values = [f"cast(if(id % {em + 2} = 0 or {em} = 3, null, id * {em + 1}) as double) as local_power_pred_{em:02d}" for em in range(12)]
    wide = spark.range(40).selectExpr(*at, *values)
    rows = ensemble_long(wide, area.ISSUE, ["local_power_pred"], members=range(12))
    told, other = ({r["bidding_area"]: r["member_sums"] for r in area.ensemble_sums(x).collect()} for x in (wide, rows))
    assert told == other and len(told) == 3 and {len(v) for v in told.values()} == {10, 11}


@pytest.mark.parametrize("n", [1, 2, 3, 40, 5000])
def test_exact_quantiles_of_any_size(spark, n):
    rng = np.random.default_rng(n)
    values = np.round(rng.normal(size=n), 2)
    rows = [("a", float(v)) for v in values] + [("a", float("nan")), ("a", None), ("b", float("nan"))]
    qs = {"low": 0.0, "q1": 0.05, "mid": 0.5, "q9": 0.97, "top": 1.0}
    got = {r["g"]: r for r in ranks.exact_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", qs).collect()}
    assert set(got) == {"a"} and got["a"]["n"] == n
    for name, q in qs.items():
        assert got["a"][name] == pytest.approx(np.quantile(values, q), abs=1e-12)


def test_exact_quantiles_beyond_the_sketch(spark):
    df = spark.range(150_000).select(F.pmod(F.xxhash64("id"), F.lit(90_000)).cast("double").alias("v"))
    values = np.sort(df.toPandas()["v"])
    got = ranks.exact_quantiles(df, [], "v", {"a": 0.001, "b": 0.5, "c": 0.9999}).first()
    assert [got[c] for c in "abc"] == pytest.approx([np.quantile(values, q) for q in (0.001, 0.5, 0.9999)])


def test_two_sample_statistic_leaves_nan_out(spark):
    rows = [(float(v), v % 3 == 0) for v in range(90)] + [(float("nan"), True), (None, False)]
    got = ranks.two_sample_ks(spark.createDataFrame(rows, "v double, a boolean"), "v", F.col("a")).first()
    assert (got["n1"], got["n2"]) == (30, 60) and 0 < got["ks"] < 0.1 and got["p_value"] > 0.9


def test_grid_is_spread_and_starts_inside_the_join(spark):
    times = spark.range(4000).selectExpr("timestamp_seconds(id * 3600) as time_ref", "timestamp_seconds(id * 3600 + 7200) as time")
    units = spark.range(30).selectExpr("id as unit", "timestamp_seconds(id * 360000) as begun")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # a table this small would be put together again after the count
    grid = reshape.dense_grid(units, times.unionAll(times), keep=F.col("time_ref") > F.col("begun"))
    sizes = [r["count"] for r in grid.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == sum(max(0, 4000 - 100 * k - 1) for k in range(30)) and len(sizes) > 1 and max(sizes) < 0.6 * sum(sizes)
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    plan = grid._jdf.queryExecution().optimizedPlan().toString()
    assert "begun" in plan.split("Join")[1].splitlines()[0]


def test_tiles_of_the_grid_grow_with_units_and_times(spark):
    def grid(n_units, n_times, **sizes):
        units = spark.range(n_units).selectExpr("id as unit", "timestamp_seconds(id * 60) as begun", "'x' as _lot_name")
        times = spark.range(n_times).selectExpr("timestamp_seconds(id * 3600) as time_ref", "timestamp_seconds(id * 3600 + 7200) as time")
        return reshape.dense_grid(units, times.unionAll(times), keep=F.col("time_ref") > F.col("begun"), **sizes)

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tasks = []
        for n_units in (300, 2_000, 10_000):
            made = grid(n_units, 600, times_per_tile=100)
            sizes = made.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"), F.countDistinct("unit", "time").alias("cells")).collect()
            want = sum(max(0, 600 - 1 - k * 60 // 3600) for k in range(n_units))
            assert sum(r["n"] for r in sizes) == sum(r["cells"] for r in sizes) == want
            tasks.append(len(sizes))
            assert n_units == 300 or max(r["n"] for r in sizes) < 6 * want / len(sizes)
        assert tasks[0] <= 8 < tasks[1] < tasks[2]
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = grid(2_000, 600)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_parameters_are_broadcast_and_rows_keep_their_place(spark):
    rng = np.random.default_rng(4)
    rows = [(f"a{k % 3}", [1.0, float(x)], [1.0], float(1 / (1 + np.exp(-x - 0.1 * rng.normal())))) for k, x in enumerate(rng.normal(size=600))]
    rows += [("a0", [1.0, None], [1.0], 0.5), ("new", [1.0, 0.0], [1.0], 0.5)]
    table = spark.createDataFrame(rows, "bidding_area string, x_mu array<double>, x_sigma array<double>, relative_power double")
    params = logitnormal.fit(table.where("bidding_area <> 'new'"), 2, 1)
    plan = table.join(params.select("bidding_area", "beta"), "bidding_area")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "BuildRight" in plan
    drawn = logitnormal.predict(table, params, scale=None, draws=5).collect()
    assert len(drawn) == len(rows) and sum(r["draws"] is None for r in drawn) == 2


def test_guard_raises_on_leak(spark):
    df = to_spark(spark, panel())
    early = F.col("time_ref") < F.lit("2023-06-01").cast("timestamp")
    assert not backtest.leak_check(df.filter(early), df.filter(~early)).first()["leak"]
    assert backtest.guard(df.filter(~early), df.filter(early)).agg(F.min("time_ref")).first()[0] is not None
    with pytest.raises(Exception, match="after the last training row"):
        backtest.guard(df, df).collect()


def test_holdout_and_purged_split(spark):
    df = to_spark(spark, panel())
    train, val = backtest.holdout(df, "2023-06-01", "y")
    assert train.filter("em <> 0").isEmpty() and train.agg(F.max("time_ref")).first()[0].month == 5
    assert val.filter(F.to_date("time") != F.date_add(F.to_date("time_ref"), 2)).isEmpty()
    assert train.select("sample_weight").distinct().collect()[0][0] == 1.0
    ids = spark.range(1000).select(F.timestamp_add("HOUR", F.col("id").cast("int"), F.lit("2024-01-01").cast("timestamp")).alias("time"))
    parts = backtest.purged_split(ids, ["time"], 0.75, 62).groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in parts} == {"train": 750, "gap": 62, "validation": 188}


def test_crps_identity_and_single_draw(spark):
    rng = np.random.default_rng(0)
    draws = rng.normal(size=(20, 15)) * 3
    y = rng.normal(size=20)
    rows = [(i, float(y[i]), [float(v) for v in draws[i]]) for i in range(20)]
    df = spark.createDataFrame(rows, "id int, y double, draws array<double>")
    got = {r["id"]: r["crps"] for r in scores.per_observation_crps(df, "y", "draws").collect()}
    opened = df.select("id", "y", F.explode("draws").alias("d"))
    long = {r["id"]: r["crps"] for r in scores.crps_from_rows(opened, ["id"], "y", "d").collect()}
    for i in range(20):
        pairwise = np.abs(draws[i][:, None] - draws[i][None, :]).mean() / 2
        want = np.abs(draws[i] - y[i]).mean() - pairwise
        assert got[i] == pytest.approx(want) and long[i] == pytest.approx(want)
    one = spark.createDataFrame([(1.0, [4.0])], "y double, draws array<double>")
    assert scores.per_observation_crps(one, "y", "draws").first()["crps"] == 3.0


def test_array_statistics(spark):
    df = spark.createDataFrame([([1.0, 4.0, 2.0, 8.0],), ([5.0],), ([],)], "v array<double>")
    v = F.col("v")
    rows = df.select(
        ensemble.array_mean(v).alias("m"), ensemble.array_std(v).alias("s"), ensemble.array_median(v).alias("h"),
        ensemble.array_quantile(F.array_sort(v), 0.3).alias("q"),
    ).collect()
    data = np.array([1.0, 4, 2, 8])
    np.testing.assert_allclose([rows[0][c] for c in "mshq"], [data.mean(), data.std(ddof=1), 3.0, np.quantile(data, 0.3)])
    assert rows[1]["s"] is None and rows[1]["h"] == 5.0 and rows[2]["m"] is None


def test_coverage_shares_add_up(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (9.0,)], "y double")
    row = df.agg(*errors.coverage("y", F.lit(2.0), F.lit(4.0), F.lit(2.5))).first()
    assert row["under"] + row["inside"] + row["over"] == 1.0 and row["over_median"] == 0.5


def test_clip_keeps_missing_and_log_is_guarded(spark):
    df = spark.createDataFrame([(None,), (0.0,), (30.0,)], "x double")
    got = [tuple(r) for r in df.select(scalars.clip("x", 1, 25), scalars.guarded_log("x"), scalars.ratio(F.lit(1.0), "x")).collect()]
    assert got[0] == (None, None, None) and got[1][0] == 1.0 and got[1][1] == pytest.approx(math.log(1e-6))
    assert got[1][2] is None and got[2][0] == 25.0


def test_lead_hours_truncates_toward_zero(spark):
    row = spark.sql(
        "SELECT timestamp'2024-01-03 00:59:59' a, timestamp'2024-01-01 09:00:00' b"
    ).select(scalars.lead_hours("a", "b"), scalars.lead_hours("b", "a")).first()
    assert tuple(row) == (39, -39)


def test_hub_air_against_plain_arithmetic(spark):
    ws, t2m, rh, mslp, hub, elev = 8.0, 10.0, 80.0, 1000.0, 100.0, 200.0
    df = spark.createDataFrame([(ws, t2m, rh, mslp, hub, elev)], "ws10m double, t2m double, rh2m double, mslp double, mean_hub_height double, elevation double")
    row = df.select(*[c.alias(n) for n, c in physics.hub_air().items()]).first()
    layer = t2m + 273.15 - 0.0065 * hub
    e = rh / 100 * 6.112 * math.exp(17.67 * t2m / (t2m + 243.5)) * 100
    p0 = mslp * 100 * math.exp(-9.80665 * elev / (287.05 * layer))
    tv = layer * (1 + 0.61 * 0.622 * e / (p0 - 0.378 * e))
    phh = mslp * 100 * math.exp(-9.80665 * (elev + hub) / (287.05 * tv))
    assert row["phh"] == pytest.approx(phh) and row["adhh"] == pytest.approx(phh / (287.05 * tv))
    assert row["wind_power_density"] == pytest.approx(0.5 * phh / (287.05 * tv) * (ws * 10**0.143) ** 3)


def test_season_repeats_daily(spark):
    df = spark.sql("SELECT timestamp'2024-07-01 06:00:00' AS time")
    row = df.select(*[c.alias(n) for n, c in seasons.season().items()]).first()
    assert row["sin_hod"] == pytest.approx(1.0) and row["cos_hod"] == pytest.approx(0.0, abs=1e-12)


def ar_series(n=420, seed=4):
    rng = np.random.default_rng(seed)
    y = np.zeros(n)
    for t in range(2, n):
        y[t] = 1 + 0.6 * y[t - 1] + 0.2 * y[t - 2] + rng.normal()
    return pd.DataFrame({"k": "a", "time": pd.date_range("2024-01-01", periods=n, freq="h"), "y": y})


def test_ar2_equals_least_squares_on_the_last_values(spark):
    frame = ar_series()
    df = spark.createDataFrame(frame)
    fitted = autoregression.ar2_coefficients(df, ["k"], "time", "y")
    forecast = autoregression.ar2_forecast(fitted, ["k"]).toPandas()
    literal = autoregression.ar2_forecast(fitted, ["k"], offset=0).toPandas()
    issued = [i for i in range(199, len(frame)) if frame.time[i].hour == 9]
    assert sorted(forecast.time_ref.unique()) == [frame.time[i] for i in issued]
    for i in issued:
        y = frame.y.to_numpy()[i - 199 : i + 1]
        a = np.column_stack([np.ones(198), y[1:-1], y[:-2]])
        c, p1, p2 = np.linalg.lstsq(a, y[2:], rcond=None)[0]
        path = list(y[-2:])
        for _ in range(63):
            path.append(c + p1 * path[-1] + p2 * path[-2])
        got = forecast[forecast.time_ref == frame.time[i]].set_index("lt")["y_pred"]
        assert got.index.min() == 39 and got.index.max() == 62
        assert got[39] == pytest.approx(path[1 + 40], rel=1e-7)
        assert literal[literal.time_ref == frame.time[i]].set_index("lt")["y_pred"][39] == pytest.approx(path[1 + 39], rel=1e-7)


def test_correlations(spark):
    frame = ar_series()
    acf = autoregression.autocorrelation(spark.createDataFrame(frame), ["k"], "time", "y", 30)
    r = np.array(acf.first()["acf"])
    c = frame.y.to_numpy() - frame.y.mean()
    np.testing.assert_allclose(r, [(c[k:] * c[: len(c) - k]).sum() / (c * c).sum() for k in range(31)], atol=1e-10)
    pacf = np.array(autoregression.partial_autocorrelation(acf, ["k"]).first()["pacf"])
    for k in (1, 2, 7):
        toeplitz = np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)])
        assert pacf[k] == pytest.approx(np.linalg.solve(toeplitz, r[1 : k + 1])[-1], abs=1e-9)


def test_augmented_dickey_fuller_by_brute_force(spark):
    frame = ar_series()
    y = frame.y.to_numpy()
    row = autoregression.augmented_dickey_fuller(spark.createDataFrame(frame), ["k"], "time", "y", 12).first()
    d = np.diff(y)

    def fit(lags, skip):
        t = np.arange(skip, len(d))
        a = np.column_stack([np.ones(len(t)), y[t], *[d[t - k] for k in range(1, lags + 1)]])
        beta, *_ = np.linalg.lstsq(a, d[t], rcond=None)
        ssr = ((d[t] - a @ beta) ** 2).sum()
        n, k = a.shape
        se = math.sqrt(ssr / (n - k) * np.linalg.inv(a.T @ a)[1, 1])
        return n * (math.log(2 * math.pi) + math.log(ssr / n) + 1) + 2 * k, beta[1] / se

    limit = min(12, math.ceil(12 * (len(y) / 100) ** 0.25))
    best = min(range(limit + 1), key=lambda lags: fit(lags, limit)[0])
    assert row["lags"] == best and row["statistic"] == pytest.approx(fit(best, best)[1], rel=1e-7)


def test_augmented_test_on_odd_series_and_its_lag_range(spark):
    series = {"three": [1.0, 2.0, 4.0], "one": [1.0], "same": [5.0] * 300, "line": [float(k) for k in range(50)], "none": []}
    rng = np.random.default_rng(5)
    series["walk"], series["noise"] = np.cumsum(rng.normal(size=900)).tolist(), rng.normal(size=900).tolist()
    start = pd.Timestamp("2023-01-01")
    rows = [(k, (start + pd.Timedelta(hours=i)).to_pydatetime(), v) for k, x in series.items() for i, v in enumerate(x)]
    got = {r["k"]: r for r in autoregression.augmented_dickey_fuller(spark.createDataFrame(rows, "k string, time timestamp, y double"), ["k"], "time", "y").collect()}
    for name in ("three", "same", "line"):
        assert got[name]["statistic"] is None and got[name]["p_value"] is None, name
    assert got["walk"]["p_value"] > 0.05 and got["noise"]["p_value"] < 0.001
    assert autoregression.most_lags(8784) == 37 and autoregression.most_lags(900) == 21 and got["noise"]["lags"] <= 21
    # The published critical values of the test with a constant.
    for statistic, p in ((-3.43, 0.01), (-2.86, 0.05), (-2.57, 0.10)):
        assert autoregression.unit_root_p_value(statistic) == pytest.approx(p, rel=0.02)
    assert autoregression.unit_root_p_value(5.0) == 1.0 and autoregression.unit_root_p_value(-40.0) == 0.0 and autoregression.unit_root_p_value(None) is None


def test_logit_normal_recovers_parameters(spark):
    rng = np.random.default_rng(7)
    n, beta, gamma = 3000, np.array([-0.5, 0.8]), np.array([-0.7, 0.3])
    x, s = np.column_stack([np.ones(n), rng.normal(size=n)]), np.column_stack([np.ones(n), rng.normal(size=n)])
    z = x @ beta + np.exp(s @ gamma) * rng.normal(size=n)
    rows = [("A", x[i].tolist(), s[i].tolist(), float(1 / (1 + np.exp(-z[i]))), 100.0) for i in range(n)]
    df = spark.createDataFrame(rows, "bidding_area string, x_mu array<double>, x_sigma array<double>, relative_power double, operating_power_max double")
    params = logitnormal.fit(df, 2, 2)
    row = params.first()
    assert row["change"] < 1e-6
    np.testing.assert_allclose(row["beta"], beta, atol=0.06)
    np.testing.assert_allclose(row["gamma"], gamma, atol=0.06)
    # The slope of the penalised likelihood is zero at the mode.
    r = np.log(df.toPandas()["relative_power"].clip(1e-4, 1 - 1e-4).to_numpy())
    p = df.toPandas()["relative_power"].clip(1e-4, 1 - 1e-4).to_numpy()
    r = np.log(p / (1 - p)) - x @ np.array(row["beta"])
    prec = np.exp(-2 * s @ np.array(row["gamma"]))
    np.testing.assert_allclose(x.T @ (r * prec) - np.array(row["beta"]) / 4, 0, atol=1e-5)
    np.testing.assert_allclose(s.T @ (r * r * prec - 1) - np.array(row["gamma"]) * 25, 0, atol=1e-5)
    drawn = logitnormal.predict(df, params, draws=99)
    share = drawn.select(
        *[c.alias(n_) for n_, c in logitnormal.quantile_columns("draws", (0.05, 0.5, 0.95)).items()], "relative_power"
    ).agg(*errors.coverage(F.col("relative_power") * 100, "q050", "q950", "q500")).first()
    assert 0.87 < share["inside"] < 0.93 and 0.45 < share["over_median"] < 0.55


def test_joint_covariance_of_the_area_model(spark):
    rng = np.random.default_rng(9)
    n = 150
    x, s = np.column_stack([np.ones(n), rng.normal(size=n)]), np.column_stack([np.ones(n), rng.normal(size=n)])
    z = np.clip(x @ [0.2, 0.7] + np.exp(s @ [-0.6, 0.3]) * rng.normal(size=n), -6, 6)
    rows = [("A", x[i].tolist(), s[i].tolist(), float(1 / (1 + np.exp(-z[i])))) for i in range(n)] + [("A", [1.0, None], [1.0, 0.0], 0.5)]
    df = spark.createDataFrame(rows, "bidding_area string, x_mu array<double>, x_sigma array<double>, relative_power double")
    params = logitnormal.fit(df, 2, 2)
    row = params.first()
    at = np.concatenate([row["beta"], row["gamma"]])

    def posterior(theta):
        r, scale = z - x @ theta[:2], s @ theta[2:]
        return (-scale - r * r * np.exp(-2 * scale) / 2).sum() - (theta[:2] ** 2).sum() / 8 - (theta[2:] ** 2).sum() / (2 * 0.04)

    h = 1e-4
    steps = h * np.eye(4)
    curve = -np.array([[(posterior(at + a + b) - posterior(at + a - b) - posterior(at - a + b) + posterior(at - a - b)) / (4 * h * h) for b in steps] for a in steps])
    cov = np.array(row["cov"]).reshape(4, 4)
    np.testing.assert_allclose(cov, np.linalg.inv(curve), rtol=2e-3, atol=1e-6)
    assert np.abs(cov[:2, 2:]).max() > 0 and np.diag(cov)[2:].min() > 0
    beta, gamma = logitnormal.parameter_draws(at[:2], at[2:], cov, 40_000)
    np.testing.assert_allclose(np.cov(np.hstack([beta, gamma]).T), cov, atol=0.03 * np.diag(cov).max())
    slopes = logitnormal.gradient(df, params).toPandas()
    assert (slopes["n"] == n).all() and sorted(slopes["column"]) == [0, 1, 2, 3] and slopes["slope"].abs().max() < 1e-4
    drawn = logitnormal.predict(df, params, scale=None, draws=400).collect()
    wide = [r["draws"] for r in drawn if r["draws"] is not None]
    assert len(wide) == n and all(d == sorted(d) for d in wide)
    again = logitnormal.predict(df.repartition(3), params, scale=None, draws=400).collect()
    assert sorted(map(tuple, wide)) == sorted(tuple(r["draws"]) for r in again if r["draws"] is not None)


def test_bands(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], 2.5)], "member_sums array<double>, power double")
    row = bands.normal_band(df).first()
    assert row["upper"] == pytest.approx(2 + 1.96) and row["residual"] == pytest.approx(-0.5)
    history = spark.createDataFrame([(1, float(v), 0.0) for v in range(-50, 51)], "lt int, y_true double, y_pred double")
    band = bands.quantile_band(spark.createDataFrame([(1, 10.0)], "lt int, y_pred double"), history, ["lt"]).first()
    assert band["q05"] == 0.0 and band["q95"] == pytest.approx(55.0)


def test_trees_keep_keys_and_beat_the_mean(spark):
    frame = panel(800)
    df = to_spark(spark, frame)
    early = F.col("time_ref") < F.lit("2023-07-01").cast("timestamp")
    train, pred = df.filter(early), df.filter(~early)
    out, model = trees.first_member_model(train, pred, ["x1", "x2"], "y", "w", params=boosting.Params(rounds=10, depth=3))
    assert out.count() == pred.count() and {"time_ref", "windpark", "local_power_pred"} <= set(out.columns)
    scored = out.filter("y IS NOT NULL").agg(
        errors.rmse(F.col("y") * F.col("w"), "local_power_pred").alias("m"), F.stddev(F.col("y") * F.col("w")).alias("s")
    ).first()
    assert scored["m"] < 0.7 * scored["s"]
    assert model.importance()[0][0] == "x1" and model.n_trees == 10
    trials, _ = trees.tune(train, pred, ["x1", "x2"], "y", "w", {"depth": [1, 3], "rounds": [2]}, "s")
    rows = trials.orderBy("trial").collect()
    assert [r["params"]["depth"] for r in rows] == ["1", "3"] and all(r["n_trees"] <= 2 for r in rows)


def test_members_that_occur_have_models(spark):
    frame = panel(600, seed=7)
    frame["em"] = np.where(frame["em"] == 0, 3, 20)
    df = to_spark(spark, frame).filter("y IS NOT NULL")
    at = F.col("time_ref")
    train, held, pred = df.filter(at < "2023-05-01"), df.filter((at >= "2023-05-01") & (at < "2023-07-01")), df.filter(at >= "2023-07-01")
    unknown = pred.limit(3).withColumn("em", F.lit(31))
    out, _ = trees.member_models(
        train, pred.unionByName(unknown), ["x1", "x2"], "y", validation=held.filter("em = 3"), params=boosting.Params(rounds=3, depth=2)
    )
    rows = {r["em"]: r for r in out.groupBy("em").agg(F.count("*").alias("n"), F.count("local_power_pred").alias("known")).collect()}
    assert {em for em, r in rows.items() if r["n"] == r["known"]} == {3, 20}
    assert (rows[31]["n"], rows[31]["known"]) == (3, 0)
    assert rows[3]["n"] + rows[20]["n"] == pred.count()


def test_catalog_models_are_not_shrunken(spark, monkeypatch):
    """Every registered tree fit sees all features and stops on a time holdout with patience; the study has 30 trials of seven settings."""
    import __spark_entry__ as entry
    from forecastlab.catalog import models
    from forecastlab.plans import local

    fits, whole = [], trees.fit

    def short(rows, features, target, jobs, *others, **settings):
        fits.append((list(features), len(jobs), {(j.params.rounds, j.params.patience) for j in jobs}, rows.filter("_held").count() > 0))
        cut = [replace(j, params=replace(j.params, rounds=1, depth=1)) for j in jobs]
        return whole(rows, features, target, cut, *others, **settings)

    monkeypatch.setattr(trees, "fit", short)
    for name, features, n in (
        ("mdl_boosted_em0", local.LOCAL_FEATURES, 1), ("mdl_boosted_pooled", local.LOCAL_FEATURES, 1), ("mdl_boosted_per_member", local.LOCAL_FEATURES, 15),
        ("mdl_boosted_area", models.AREA_TREE, 1), ("mdl_importance", local.LOCAL_FEATURES, 1), ("mdl_tune", local.LOCAL_FEATURES, 30),
    ):
        fits.clear()
        assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
        assert fits == [(list(features), n, {(1000, 20)}, True)], name
    assert all(len({getattr(p, name) for p in models.TRIALS}) > 1 for name in trees.TUNED)


@pytest.fixture(scope="module")
def rolled(spark):
    from forecastlab.catalog import models
    from forecastlab.catalog.lab import Lab

    return models.rolling_table(Lab(spark, "/root/testdata/sf0.001"))


def test_rolling_ridge_uses_all_features(spark, rolled):
    from forecastlab.catalog import models

    out = models.rolling_ridge(rolled)
    rows, names = models.ridge_table(rolled)
    assert len(names) == 1 + 36 + 3
    frame = rows.filter("em = 0 AND local_relative_power IS NOT NULL").toPandas()
    last = out.agg(F.max("block")).first()[0]
    train = frame[frame.time_ref < last]
    x, w = train[names].to_numpy(float), train[models.WEIGHT].to_numpy(float)[:, None]
    shrink = models.RIDGE * np.diag([0.0] + [1.0] * (len(names) - 1))
    beta = np.linalg.solve(x.T @ (x * w) + shrink, (x * w).T @ train[models.TARGET].to_numpy(float))
    got = out.filter(F.col("block") == F.lit(last)).toPandas()
    assert len(got) and got["em"].nunique() == 15
    np.testing.assert_allclose(got["local_power_pred"], got[names].to_numpy(float) @ beta * got[models.WEIGHT], rtol=1e-4, atol=1e-3)


def test_rolling_trees_see_all_features_and_all_rows_before_a_block(spark, rolled, monkeypatch):
    import __spark_entry__ as entry
    from forecastlab.catalog import models
    from forecastlab.plans import local

    fits, whole = [], trees.fit

    def short(rows, features, target, jobs, weight, *others, **settings):
        fits.append((list(features) == local.LOCAL_FEATURES, weight, [j.high for j in jobs], rows.filter("_held").count() > 0))
        return whole(rows, features, target, [replace(j, params=replace(j.params, rounds=1, depth=1)) for j in jobs], weight, *others, **settings)

    monkeypatch.setattr(trees, "fit", short)
    assert {"bt_rolling_trees", "bt_rolling_ridge"} <= set(entry.queries())
    # The last months only; all of them in one go.
    monkeypatch.setattr(models, "FIRST", "2001-05-01")
    monkeypatch.setattr(models, "ROLLING_HOLDOUT", "2001-01-01")
    out = models.rolling_trees(rolled)
    (early, months) = fits
    assert early[0] and months[0] and early[1] == months[1] == models.WEIGHT and early[3] and not months[3]
    assert months[2] == list(range(1, len(months[2]) + 1)) and len(months[2]) > 1
    late = rolled.filter(F.col("time_ref") >= "2001-06-01").count()
    assert out.filter(F.col("time_ref") >= "2001-06-01").count() == late > 0
    assert out.filter(F.col("local_power_pred").isNull() & F.col(models.WEIGHT).isNotNull()).count() == 0


def test_months_grown_together_equal_refits(spark):
    frame = panel(700, seed=3)
    df = to_spark(spark, frame).withColumn("em", F.lit(0))
    known, params = df.filter("y IS NOT NULL"), boosting.Params(rounds=3, depth=3, eta=0.5)
    edges = boosting.bin_edges(known, ["x1", "x2"])
    whole = trees.fit
    try:
        trees.fit = lambda *a, **k: whole(*a, **{**k, "edges": edges})
        out, models = trees.monthly_models(df, known, ["x1", "x2"], "y", "2023-08-01", "w", params)
        looped = backtest.rolling_models(
            df, "y", "2023-08-01", lambda rows: trees.grow(rows, ["x1", "x2"], "y", [boosting.Job("m", params)], "w")[0],
            lambda model, rows: boosting.predict([model], rows),
        )
    finally:
        trees.fit = whole
    keys = ["time_ref", "time", "windpark", "x1"]
    one, other = (x.select(*keys, "local_power_pred").toPandas().sort_values(keys) for x in (out, looped))
    assert len(models) >= 3 and len(one) == len(other) > 0
    np.testing.assert_allclose(one["local_power_pred"], other["local_power_pred"], atol=1e-9)
