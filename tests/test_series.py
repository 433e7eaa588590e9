import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from forecastlab.operators import series


def hourly(n, seed=3, keys=("a", "b"), holes=True):
    rng = np.random.default_rng(seed)
    start = pd.Timestamp("2024-01-25")
    parts = []
    for k in keys:
        frame = pd.DataFrame({"k": k, "time": start + pd.to_timedelta(np.arange(n), "h"), "x": rng.normal(size=n) * 10})
        parts.append(frame.sample(frac=0.8, random_state=seed).sort_values("time") if holes else frame)
    return pd.concat(parts, ignore_index=True)


def collected(df, *order):
    return df.toPandas().sort_values(list(order)).reset_index(drop=True)


def test_position_counts_across_buckets(spark):
    frame = hourly(400)
    got = collected(series.with_position(spark.createDataFrame(frame), ["k"], ["time"], series.month_of("time")), "k", "time")
    assert (got["pos"] == got.groupby("k").cumcount()).all()


def test_position_without_keys(spark):
    frame = hourly(300, keys=("a",))
    df = spark.createDataFrame(frame)
    got = collected(series.with_position(df, [], ["time"], F.date_trunc("DAY", "time")), "time")
    assert got["pos"].tolist() == list(range(len(frame)))
    assert collected(series.global_position(df.repartition(7), ["time"]), "time")["pos"].tolist() == list(range(len(frame)))


@pytest.mark.parametrize("chunk", [24, 37, 4096])
def test_frames_equal_plain_window(spark, chunk):
    df = spark.createDataFrame(hourly(300))
    columns = lambda w: {
        "r": series.rolling(F.avg, "x", 24, w), "l": F.lag("x", 3).over(w), "f": F.lead("x", 2).over(w)
    }
    got = collected(series.series_columns(df, ["k"], "time", columns, before=23, after=2, chunk=chunk), "k", "time")
    want = collected(df.withColumns(columns(Window.partitionBy("k").orderBy("time"))), "k", "time")
    pd.testing.assert_frame_equal(got[want.columns], want)


def test_rolling_is_null_until_full_and_on_missing(spark):
    frame = pd.DataFrame({"k": "a", "time": pd.date_range("2024-01-01", periods=5, freq="h"), "x": [1.0, 2, None, 4, 5]})
    df = spark.createDataFrame(frame).withColumn("x", F.nanvl("x", F.lit(None).cast("double")))
    got = collected(series.series_columns(df, ["k"], "time", lambda w: {"r": series.rolling(F.avg, "x", 2, w)}, before=1), "time")
    assert got["r"].tolist()[1] == 1.5 and got["r"].isna().tolist() == [True, False, True, True, False]


@pytest.mark.parametrize("alpha", [0.5, series.ewm_span(24)])
def test_ewm_equals_pandas_over_run_borders(spark, alpha):
    frame = hourly(2500, keys=("a",), holes=False)
    frame.loc[frame.index % 7 == 3, "x"] = np.nan
    frame.loc[600:1700, "x"] = np.nan
    df = spark.createDataFrame(frame).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    got = collected(series.ewm_mean(df, ["k"], "time", {"e": "x"}, alpha, means={"m": "x"}), "time")
    want = frame["x"].ewm(alpha=alpha, adjust=True, ignore_na=False).mean().where(frame["x"].notna())
    if alpha == 0.5:
        # The weights before the long hole vanish in pandas as well; compare where it has them.
        keep = want.notna()
        np.testing.assert_allclose(got["e"][keep], want[keep], rtol=0, atol=1e-9)
    else:
        np.testing.assert_allclose(got["e"], want, rtol=0, atol=1e-9)
    np.testing.assert_allclose(got["m"], frame["x"].expanding().mean(), atol=1e-9)


def test_expanding_mean_and_forward_fill_over_buckets(spark):
    frame = hourly(900, keys=("a", "b"))
    frame.loc[frame.index % 5 != 0, "x"] = np.nan
    df = spark.createDataFrame(frame).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    got = collected(series.expanding_mean(df, ["k"], "time", "x", "m"), "k", "time")
    want = frame.groupby("k")["x"].expanding().mean().reset_index(drop=True)
    np.testing.assert_allclose(got["m"], want)
    filled = collected(series.forward_fill(df, ["k"], ["time"], ["x"], series.month_of("time")), "k", "time")
    np.testing.assert_allclose(filled["x"], frame.groupby("k")["x"].ffill())


def test_fill_gaps_makes_a_regular_series(spark):
    frame = hourly(200, keys=("a",))
    got = collected(series.fill_gaps(spark.createDataFrame(frame), ["k"], "time", ["x"]), "time")
    want = frame.set_index("time")["x"].asfreq("h").ffill()
    assert got["time"].tolist() == want.index.tolist()
    np.testing.assert_allclose(got["x"], want)


def test_issue_arrays_need_full_history_and_future(spark):
    frame = hourly(200, keys=("a",), holes=False)
    got = collected(series.issue_arrays(spark.createDataFrame(frame), ["k"], "time", "x", 48, 39, 24), "time_ref")
    values = frame.set_index("time")["x"]
    expected = [
        t for t in values.index
        if t.hour == 9 and t - pd.Timedelta("47h") >= values.index[0] and t + pd.Timedelta("62h") <= values.index[-1]
    ]
    assert got["time_ref"].tolist() == expected
    for _, row in got.iterrows():
        t = row["time_ref"]
        np.testing.assert_allclose(row["lookback"], values[t - pd.Timedelta("47h"):t])
        np.testing.assert_allclose(row["target"], values[t + pd.Timedelta("39h"):t + pd.Timedelta("62h")])


def test_gaps(spark):
    times = [dt.datetime(2024, 1, d, 9) for d in (1, 1, 2, 3, 6, 7, 9)]
    got = collected(series.gaps(spark.createDataFrame([(t,) for t in times], "time timestamp"), "time", 24), "time")
    assert got["hours_since_last"].tolist() == [72, 48]
