"""What keeps the larger queries small: fewer shuffled and written bytes, same rows."""

import glob
import math

from pyspark.sql import functions as F

import __spark_entry__ as entry
from forecastlab.catalog.lab import Lab
from forecastlab.functions.scalars import round_to
from forecastlab.session import shared_dir

SMALL = "/root/testdata/sf0.001"


def test_round_to_is_round(spark):
    values = [0.0, -0.0, 0.5e-6, -0.5e-6, 1.0000005, 2.5, 123456.7890125, -3.3333335, 1e12 + 0.1234565, 1e-9, -1e-9, None, math.nan, math.inf]
    rows = spark.createDataFrame([(v,) for v in values], "x double").unionAll(spark.range(2000).select(((F.col("id") - 1000) / 8192 * 1.7).alias("x")))
    for digits in (3, 5, 6):
        assert rows.filter(~round_to("x", digits).eqNullSafe(F.round("x", digits))).count() == 0


def test_landed_forecast_text_is_compressed(spark):
    before = set(glob.glob(f"{shared_dir(spark)}/forecastlab/forecast-*"))
    assert entry.queries()["src_csv_typed_na"](spark, SMALL).count() > 0
    (path,) = set(glob.glob(f"{shared_dir(spark)}/forecastlab/forecast-*")) - before
    assert glob.glob(f"{path}/*.csv.gz") and not glob.glob(f"{path}/*.csv")


def test_lead_time_windows_move_no_wide_rows(spark):
    # One exchange, below the aggregate that makes the rows; the window finds them in place.
    plan = entry.queries()["win_centered_mean3"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_training_rows_are_narrow_and_cells_are_not_written(spark):
    before = set(glob.glob(f"{shared_dir(spark)}/forecastlab/local_cells-*"))
    lab = Lab(spark, SMALL)
    assert lab.first_rows.filter(F.col("local_relative_power").isNull()).count() == 0 < lab.first_rows.count()
    assert set(glob.glob(f"{shared_dir(spark)}/forecastlab/local_cells-*")) == before


def exchanges(frame):
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


def test_local_table_moves_no_row_per_member_or_cell(spark):
    # The grid is joined per unit and issue, the wide forecast is moved once; neither cells nor members are dealt again.
    table = Lab(spark, SMALL).local_table
    assert table.filter(F.col("em").isNotNull()).count() > 0
    assert not [line for line in exchanges(table) if " em#" in line or "(windpark_statnet" in line and " time#" in line]
    for name in ("feat_local_dataset", "feat_local_issue"):
        assert not [line for line in exchanges(entry.queries()[name](spark, SMALL)) if " em#" in line], name


def test_local_table_is_the_same_from_long_and_wide_forecasts(spark):
    from forecastlab.plans import local

    lab = Lab(spark, SMALL)
    long = local.local_dataset(lab.units, lab.unit_power, lab.forecast, lab.nowcast, lab.outages)
    wide = lab.local_table
    assert long.columns == wide.columns
    told = [
        x.groupBy("windpark", "em").agg(
            F.count(F.lit(1)).alias("n"), *[F.round(F.sum(F.col(c).cast("double")), 3).alias(c) for c in (*local.LOCAL_FEATURES[:6], "wind_alignment", "adhh", "local_power")]
        ).toPandas().sort_values(["windpark", "em"]).reset_index(drop=True)
        for x in (long, wide)
    ]
    assert len(told[0]) > 10 and told[0].equals(told[1])


def test_every_production_row_of_a_time_stays(spark):
    # Two production rows of one unit and time are two rows of the table, as a left join gives.
    from forecastlab.plans import local

    lab = Lab(spark, SMALL)
    twice = local.local_dataset(lab.units, lab.unit_power.unionAll(lab.unit_power), lab.forecast_wide.withColumnRenamed("sid", "windpark_statnet"), lab.nowcast, lab.outages)
    known = F.col("local_power").isNotNull()
    assert twice.filter(known).count() == 2 * lab.local_table.filter(known).count() > 0
    assert twice.filter(~known).count() == lab.local_table.filter(~known).count() > 0


def test_ridge_lines_write_fitted_rows_only(spark):
    # Neither the rows of all members nor a second copy of them with the terms.
    folder = f"{shared_dir(spark)}/forecastlab"
    before = set(glob.glob(f"{folder}/*"))
    for name in ("bt_rolling_ridge", "eval_loo_station_full"):
        entry.queries()[name](spark, SMALL)
    written = set(glob.glob(f"{folder}/*")) - before
    assert not [path for path in written if "rolling_table" in path or "ridge_table" in path]
    fitted = [spark.read.parquet(path) for path in written if "ridge_rows" in path]
    assert len(fitted) == 2 and all(rows.count() > 0 == rows.filter(F.col("local_relative_power").isNull()).count() for rows in fitted)


def test_rolling_trees_write_known_rows_only(spark, monkeypatch):
    # The predicted rows of all members are read as they are made; the rows to learn from are written once for all models of the report.
    from forecastlab.catalog import models

    monkeypatch.setattr(models, "ROLLING", models.replace(models.ROLLING, rounds=1, depth=1))
    folder = f"{shared_dir(spark)}/forecastlab"
    for name, members in (("bt_rolling_trees", 1), ("eval_report_calibrated", 15)):
        before = set(glob.glob(f"{folder}/*"))
        entry.queries()[name](spark, SMALL)
        written = set(glob.glob(f"{folder}/*")) - before
        assert not [path for path in written if "rolling_table" in path], name
        (known,) = [spark.read.parquet(path) for path in written if "tree_rows" in path]
        assert known.count() > 0 == known.filter(F.col("local_relative_power").isNull()).count() and known.select("em").distinct().count() == members, name


def test_first_member_models_write_what_they_use(spark):
    from forecastlab.catalog import models

    lab = Lab(spark, SMALL)
    train, held, later = models.first_split(lab)
    whole = models.full_split(lab)
    first = F.col("em") == 0
    assert train.filter(~first).count() == held.filter(~first).count() == 0 < train.count() == whole[0].filter(first).count()
    assert held.count() == whole[1].filter(first).count() and later.count() == whole[2].count() > 0


def test_units_meet_narrow_forecasts(spark):
    # Where units are too many to broadcast, the rows that are shuffled for them don't have the members side by side.
    def joins(node):
        found = [node] if node.nodeName() == "Join" else []
        return found + [j for k in range(node.children().size()) for j in joins(node.children().apply(k))]

    lab = Lab(spark, SMALL)
    for table in (entry.queries()["feat_hub_air"](spark, SMALL), lab.local_pred_wide, lab.local_cells):
        found = joins(table._jdf.queryExecution().optimizedPlan())
        assert found and all(j.children().apply(k).output().size() < 20 for j in found for k in range(2))


def test_asked_nowcasts_equal_the_whole(spark):
    from forecastlab.plans import local

    lab = Lab(spark, SMALL)
    issues = lab.calendar.select("time_ref").distinct()
    assert lab.calendar.exceptAll(lab.forecast_wide.select("time_ref", "time").distinct()).count() == 0 < lab.calendar.count() == lab.forecast_wide.select("time_ref", "time").distinct().count()
    whole = local.nowcast_features(lab.nowcast).join(issues, "time_ref", "left_semi")
    asked = local.nowcast_features(lab.nowcast, asked=issues)
    keys = ["windpark_statnet", "time_ref"]
    columns = [*keys, *[c for c in whole.columns if c not in keys]]
    assert set(asked.columns) == set(whole.columns)
    one, other = (x.select(columns).toPandas().sort_values(keys).reset_index(drop=True) for x in (asked, whole))
    import pandas as pd

    pd.testing.assert_frame_equal(one, other)
    assert len(one) > 10
