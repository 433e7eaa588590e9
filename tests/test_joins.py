import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from forecastlab.operators import capacity, intervals, matching, ranks, reshape
from forecastlab.plans import truth


def at(day, hour=0, minute=0):
    return dt.datetime(2024, 1, day, hour, minute)


EVENTS = "u long, publicationDate timestamp, eventStart timestamp, eventStop timestamp, lost double, flag boolean"


def test_visibility_is_strict_on_publication_and_inclusive_on_bounds(spark):
    events = spark.createDataFrame(
        [(1, at(1, 9), at(2, 6), at(2, 12), 5.0, True), (1, at(1, 8, 59), at(2, 6, 1), at(2, 11, 59), 7.0, False)], EVENTS
    )
    rows = spark.createDataFrame(
        [(1, at(1, r), at(2, t)) for r in (9, 10) for t in (5, 6, 7, 11, 12, 13)], "u long, time_ref timestamp, time timestamp"
    )
    got = {
        (r["time_ref"].hour, r["time"].hour): (r["lost"], r["flag"])
        for r in intervals.visible_totals(rows, events, ["u"], ["lost"], ["flag"]).collect()
    }
    assert got == {
        (9, 7): (7.0, False), (9, 11): (7.0, False), (10, 6): (5.0, True), (10, 7): (12.0, True),
        (10, 11): (12.0, True), (10, 12): (5.0, True),
    }


def test_totals_equal_the_sum_over_pairs(spark):
    rng = np.random.default_rng(5)
    base = pd.Timestamp("2024-01-01")
    minutes = rng.integers(0, 20 * 1440, 400)
    start = minutes + rng.integers(0, 4000, 400)
    events = pd.DataFrame({
        # One key holds most of the rows.
        "u": np.where(rng.random(400) < 0.6, 0, rng.integers(1, 5, 400)),
        "publicationDate": base + pd.to_timedelta(minutes, "min"),
        "eventStart": base + pd.to_timedelta(start, "min"),
        "eventStop": base + pd.to_timedelta(start + rng.integers(-60, 3000, 400), "min"),
        "lost": rng.integers(1, 50, 400).astype(float),
        "flag": rng.random(400) < 0.3,
    })
    rows = pd.DataFrame({
        "u": rng.integers(0, 5, 600),
        "time_ref": base + pd.to_timedelta(rng.integers(0, 22 * 24, 600), "h"),
        "time": base + pd.to_timedelta(rng.integers(0, 25 * 24, 600), "h"),
    }).drop_duplicates()
    e, r = spark.createDataFrame(events), spark.createDataFrame(rows)
    totals = intervals.visible_totals(r, e, ["u"], ["lost"], ["flag"]).toPandas()
    pairs = intervals.visible_pairs(r, e, ["u"]).groupBy("u", "time_ref", "time").agg(
        F.sum("lost").alias("lost"), F.bool_or("flag").alias("flag")
    ).toPandas()
    brute = rows.merge(events, on="u")
    brute = brute[(brute.time_ref > brute.publicationDate) & (brute.time >= brute.eventStart) & (brute.time <= brute.eventStop)]
    brute = brute.groupby(["u", "time_ref", "time"], as_index=False).agg(lost=("lost", "sum"), flag=("flag", "max"))
    order = ["u", "time_ref", "time"]
    want = brute.sort_values(order).reset_index(drop=True)
    assert len(want) > 20
    for got in (totals, pairs):
        pd.testing.assert_frame_equal(
            got.sort_values(order).reset_index(drop=True)[want.columns], want, check_dtype=False
        )


def test_hours_nobody_asks_for_are_not_shuffled(spark):
    # A message of 200 days and one asked hour in it: one row is left before anything is dealt by key.
    events = spark.createDataFrame([(1, at(1), at(2), at(2) + dt.timedelta(days=200), 5.0, True)], EVENTS)
    rows = spark.createDataFrame([(1, at(2), at(3, 6)), (1, at(2), at(3, 6)), (2, at(2), at(1))], "u long, time_ref timestamp, time timestamp")
    assert [r["time"] for r in intervals.covered_hours(events, rows.select("time").distinct(), ["u"]).collect()] == [at(3, 6)]
    assert [tuple(r) for r in intervals.covered_cells(events, rows.select("time_ref", "time").distinct(), ["u"]).collect()] == [(1, at(2), at(3, 6))]
    plan = intervals.visible_totals(rows, events, ["u"], ["lost"])._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan
    assert [tuple(r) for r in intervals.visible_totals(rows, events, ["u"], ["lost"]).collect()] == [(1, at(2), at(3, 6), 5.0)]


def test_off_hour_rows_raise(spark):
    events = spark.createDataFrame([(1, at(1), at(2), at(3), 1.0, True)], EVENTS)
    rows = spark.createDataFrame([(1, at(2, 9, 30), at(2, 12))], "u long, time_ref timestamp, time timestamp")
    with pytest.raises(Exception, match="whole hours"):
        intervals.visible_totals(rows, events, ["u"], ["lost"]).collect()


def test_capacity_counts_units_started_by_the_time(spark):
    units = spark.createDataFrame(
        [("A", at(2), 10.0), ("A", at(2), 5.0), ("A", dt.datetime(2024, 3, 1), 1.0), ("B", at(5), 7.0)],
        "bidding_area string, production_start_date timestamp, operating_power_max double",
    )
    asked = spark.createDataFrame(
        [(a, t) for a in "AB" for t in (at(1, 23), at(2), at(4), dt.datetime(2024, 4, 1))], "bidding_area string, time timestamp"
    )
    got = {(r["bidding_area"], r["time"]): r["operating_power_max"]
           for r in capacity.active_capacity(asked, units, values=["operating_power_max"]).collect()}
    assert got == {
        ("A", at(2)): 15.0, ("A", at(4)): 15.0, ("A", dt.datetime(2024, 4, 1)): 16.0, ("B", dt.datetime(2024, 4, 1)): 7.0
    }


def test_any_key_join_equals_or_condition_once_per_pair(spark):
    left = spark.createDataFrame(
        [(1, "e1", "n1"), (2, "e2", None), (3, None, "n1"), (4, "e9", "n9"), (4, "e1", "n2")], "id int, eic string, name string"
    )
    right = spark.createDataFrame(
        [(10, "e1", "n1", "x"), (11, "e2", "n2", "n1"), (12, None, None, "n9")], "rid int, code string, a string, b string"
    )
    got = sorted((r["id"], r["rid"]) for r in matching.any_key_join(left, right, [("eic", "code"), ("name", "a"), ("name", "b")]).collect())
    either = (F.col("eic") == F.col("code")) | (F.col("name") == F.col("a")) | (F.col("name") == F.col("b"))
    assert got == sorted((r["id"], r["rid"]) for r in left.crossJoin(right).filter(either).collect())


def test_unmatched_and_absent(spark):
    left = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    right = spark.createDataFrame([("b",), ("c",)], "j string")
    assert sorted(map(str, (r[0] or r[1] for r in matching.unmatched(left, right, "k", "j").collect()))) == ["None", "a", "c"]
    assert sorted(str(r["k"]) for r in matching.absent_from(left, "k", right, "j").collect()) == ["None", "a"]


def test_grid_and_horizon(spark):
    units = spark.createDataFrame([(1,), (2,)], "u int")
    times = spark.createDataFrame([(at(1), at(2)), (at(1), at(2)), (at(1), at(3))], "time_ref timestamp, time timestamp")
    assert reshape.dense_grid(units, times).count() == 4
    power = spark.createDataFrame(
        [("A", at(1, 9), 1.0), ("A", at(3, 0), 2.0), ("A", at(3, 23), 3.0), ("A", at(4, 0), 4.0), ("B", at(3, 5), 5.0)],
        "bidding_area string, time timestamp, power double",
    )
    got = sorted((r["lt"], r["y_true"]) for r in truth.evaluation_set(power).collect())
    assert got == [(39, 2.0), (62, 3.0)]


def test_missing_prediction_counts_as_zero_and_is_flagged(spark):
    pairs = spark.createDataFrame([("A", 1, 2.0), ("A", 2, 3.0)], "bidding_area string, lt int, y_true double")
    pred = spark.createDataFrame([("A", 1, 2.5)], "bidding_area string, lt int, y_pred double")
    got = {r["lt"]: (r["y_pred"], r["filled"]) for r in truth.with_prediction(pairs, pred, ["bidding_area", "lt"]).collect()}
    assert got == {1: (2.5, False), 2: (0.0, True)}


def test_bilinear_inside_on_the_edge_and_outside(spark):
    cells = spark.createDataFrame([(x, y, float(10 * x + y * y)) for x in range(3) for y in range(3)], "ix int, iy int, value double")
    points = spark.createDataFrame([(1, 0.25, 0.5), (2, 2.0, 2.0), (3, 2.5, 1.0)], "id int, x double, y double")
    got = {r["id"]: r["value"] for r in reshape.bilinear(points, cells, "id").collect()}
    assert got[1] == pytest.approx(2.5 + 0.5) and got[2] == 24.0 and got[3] is None
    assert {r["id"]: r["value"] for r in reshape.bilinear(points, cells, "id", fill=0.0).collect()}[3] == 0.0


def test_exact_quantiles_on_a_large_and_a_small_group(spark):
    rng = np.random.default_rng(2)
    big = np.round(rng.lognormal(size=250_000), 4)
    small = rng.normal(size=7)
    frame = pd.DataFrame({"g": ["big"] * len(big) + ["small"] * 7 + ["one"], "v": np.concatenate([big, small, [4.0]])})
    qs = {"q05": 0.05, "q50": 0.5, "q975": 0.975}
    df = spark.createDataFrame(frame).repartition(8)
    got = ranks.exact_quantiles(df, ["g"], "v", qs).toPandas().set_index("g")
    for g, values in (("big", big), ("small", small), ("one", np.array([4.0]))):
        np.testing.assert_allclose(got.loc[g, list(qs)].astype(float), np.quantile(values, list(qs.values())), rtol=1e-12)
    whole = ranks.exact_quantiles(df, [], "v", qs).first()
    np.testing.assert_allclose([whole[q] for q in qs], np.quantile(frame["v"], list(qs.values())), rtol=1e-12)


@pytest.mark.parametrize("digits", [0, 6])
def test_two_sample_statistic(spark, digits):
    rng = np.random.default_rng(8)
    a, b = np.round(rng.normal(size=700), digits), np.round(rng.normal(0.3, size=400), digits)
    frame = pd.DataFrame({"v": np.concatenate([a, b]), "first": [True] * 700 + [False] * 400})
    row = ranks.two_sample_ks(spark.createDataFrame(frame), "v", F.col("first")).first()
    values = np.unique(frame["v"])
    share = lambda x: np.searchsorted(np.sort(x), values, side="right") / len(x)
    assert row["ks"] == pytest.approx(np.abs(share(a) - share(b)).max())
    assert 0 <= row["p_value"] <= 1 and (row["n1"], row["n2"]) == (700, 400)


def test_first_per_key_takes_the_explicit_order(spark):
    df = spark.createDataFrame([(1, "b", True), (1, "a", True), (1, "c", False), (2, "z", True)], "k int, n string, f boolean")
    got = {r["k"]: r["n"] for r in ranks.first_per_key(df, ["k"], ["f", "n"]).collect()}
    assert got == {1: "c", 2: "z"}
