import json

import pytest
from pyspark.sql import functions as F

from forecastlab.plans import area, local, report, summaries, units
from forecastlab.sources import files, messages, schemas


def test_unit_power_file(spark, tmp_path):
    path = tmp_path / "power.csv"
    path.write_text(
        "time;Nord Å;Sør\nid;20;72\n2020-01-01 01:00:00;1,5;2\n2020-01-01 02:00:00;1,25;\n2020-01-01 03:00:00;x;0,5\n",
        encoding="utf-8",
    )
    rows = files.read_unit_power(spark, str(path)).collect()
    got = sorted((r["time"].hour, r["windpark_nve"], r["local_power"], r["windpark_nve_id"]) for r in rows)
    # 01:00 at UTC+1 is midnight UTC, which is not after the start; text that is no number is dropped.
    assert got == [(1, "Nord Å", 1.25, 20), (2, "Sør", 0.5, 72)]


def test_typed_csv_with_na(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_text("sid,time_ref,x\nA,2024-01-01T09:00:00Z,NA\nB,2024-01-02T09:00:00Z,1.5\n")
    rows = files.read_csv_like(spark, str(path), "sid string, time_ref timestamp, x double").orderBy("sid").collect()
    assert rows[0]["x"] is None and rows[1]["x"] == 1.5 and rows[1]["time_ref"].day == 2


def test_register_fills_hub_height_with_the_mean_of_all(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text(json.dumps([
        {"VindkraftAnleggId": 1, "GjsnittNavhoeyde": 80.0, "IdriftsettelseForsteByggetrinn": "2010-01-01T00:00:00"},
        {"VindkraftAnleggId": 2, "GjsnittNavhoeyde": None},
        {"VindkraftAnleggId": 3, "GjsnittNavhoeyde": 100.0},
    ]))
    rows = files.read_register(spark, str(path)).orderBy("windpark_nve_id").collect()
    assert [r["mean_hub_height"] for r in rows] == [80.0, 90.0, 100.0] and rows[0]["production_start_date"].year == 2010


def page(tmp_path):
    period = {"unavailableCapacity": 3.0, "availableCapacity": 7.0, "eventStart": "2024-01-02T00:00:00Z", "eventStop": "2024-01-03T00:00:00Z"}
    unit = {"name": "U", "eic": "E1", "installedCapacity": 10.0, "timePeriods": [period, period]}
    line = {"inAreaName": "NO5", "outAreaName": "NO2", "installedCapacity": 10.0, "timePeriods": [period]}
    items = [
        {"messageId": "a", "messageType": 1, "unavailabilityType": 1, "publicationDate": "2024-01-01T00:00:00Z", "productionUnits": [unit, unit]},
        {"messageId": "b", "messageType": 1, "unavailabilityType": 2, "generationUnits": [unit]},
        {"messageId": "c", "messageType": 1, "unavailabilityType": 2},
        {"messageId": "d", "messageType": 3, "unavailabilityType": 1, "transmissionUnits": [line, {**line, "outAreaName": "SE1"}]},
        {"messageId": "e", "messageType": 5, "areas": [{"name": "NO1", "code": "1"}, {"name": "NO2", "code": "2"}], "assets": None},
        {"messageId": "f", "messageType": 5, "areas": [{"name": "NO1", "code": "1"}], "assets": [{"name": "n", "code": "c"}]},
    ]
    path = tmp_path / "pages.json"
    path.write_text(json.dumps({"total": 7, "items": items[:3]}) + "\n" + json.dumps({"total": 7, "items": items[3:]}) + "\n")
    return str(path)


def test_messages(spark, tmp_path):
    pages = messages.read_pages(spark, page(tmp_path))
    row = messages.page_completeness(pages).first()
    assert (row["collected"], row["total"], row["complete"]) == (6, 7, False)
    items = messages.page_items(pages)
    production = messages.production_outages(items)
    assert production.filter("messageId = 'a'").count() == 4
    # A message without any unit keeps one empty row.
    assert production.filter("messageId = 'c'").first()["eic"] is None
    assert production.filter("messageId = 'b'").isEmpty()
    transmission = messages.transmission_outages(items).collect()
    assert [(r["outAreaName"], r["unplannedEvent"]) for r in transmission] == [("NO2", True)]
    market = messages.market_information(items).groupBy("messageId").agg(F.count("*").alias("n"), F.max("eic").alias("eic")).collect()
    assert {r["messageId"]: (r["n"], r["eic"]) for r in market} == {"e": (2, None), "f": (1, "c")}
    first = messages.first_unit_outages(items).filter("messageId IN ('a', 'b')").collect()
    assert len(first) == 4 and {r["eic"] for r in first} == {"E1"}


def test_best_parameters_keep_the_lowest_error(spark, tmp_path):
    path = str(tmp_path / "params")
    trials = spark.createDataFrame([("s", {"d": "1"}, 3.0), ("s", {"d": "2"}, 1.0), ("t", {"d": "9"}, 2.0)], "study string, params map<string,string>, rmse double")
    files.write_best_params(trials, path)
    files.write_best_params(spark.createDataFrame([("s", {"d": "5"}, 2.0)], trials.schema), path)
    row = files.read_best_params(spark, path, "s").first()
    assert row["params"] == {"d": "2"} and row["rmse"] == 1.0


def test_schema_names():
    assert len(schemas.names(schemas.FORECAST_WIDE)) == 94
    assert schemas.names(schemas.AREA_POWER_WIDE)[1] == "ELSPOT NO1"


def test_unit_sites_keep_the_entry_without_start(spark):
    geo = spark.createDataFrame(
        [("Sandøy", None, 1.0, 1.0), ("Sandøy", "2020", 2.0, 2.0), ("X", "2020", 3.0, 3.0)], "site_name string, started string, x double, y double"
    )
    lookup = spark.createDataFrame([(7, "Nye Sandøy"), (8, "X"), (8, "Y")], "windpark_nve_id long, windpark_nve string")
    got = {r["windpark_nve_id"]: r["x"] for r in units.unit_sites(geo, lookup).collect()}
    assert got == {7: 1.0, 8: 3.0}


def test_recent_std_compat_is_the_minimum(spark):
    rows = spark.range(30).select(
        F.lit("A").alias("bidding_area"), F.timestamp_add("HOUR", F.col("id").cast("int"), F.lit("2024-01-01").cast("timestamp")).alias("time"),
        (F.col("id") % 7).cast("double").alias("relative_power"),
    )
    compat = area.recent_block(rows, compat=True).filter("recent_std IS NOT NULL").collect()
    assert len(compat) == 7 and all(r["recent_std"] == r["recent_min"] for r in compat)
    assert all(r["recent_std"] > 0 for r in area.recent_block(rows).filter("recent_std IS NOT NULL").collect())


def test_station_mean_knows_the_future_and_the_default_does_not(spark):
    now = spark.createDataFrame(
        [("S", f"2024-01-0{d}T09:00:00Z", 5.0, 1000.0, 50.0, 0.0, float(d), 90.0) for d in (1, 2, 3)],
        "windpark string, t string, air_temperature_2m double, air_pressure_at_sea_level double, relative_humidity_2m double,"
        "precipitation_amount double, wind_speed_10m double, wind_direction_10m double",
    ).withColumn("time", F.col("t").cast("timestamp")).drop("t")
    safe = [r["location_mean_ws"] for r in local.nowcast_features(now).orderBy("time_ref").collect()]
    whole = [r["location_mean_ws"] for r in local.nowcast_features(now, leak_free=False).orderBy("time_ref").collect()]
    assert safe == [1.0, 1.5, 2.0] and whole == [2.0, 2.0, 2.0]


def test_summaries(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 10.0), ("a", 9.9), ("b", 1.0), ("b", None)], "g string, v double")
    counts = {(r["g"], r["bin"]): r["n"] for r in summaries.histogram(df, "g", "v", 10).collect()}
    assert counts == {("a", 0): 1, ("a", 9): 2, ("b", 0): 1}
    assert summaries.duplicated_keys(df, ["g"]).count() == 5
    profile = report.missing_profile(df, ["v"]).first()
    assert (profile["n"], profile["missing"], profile["low"], profile["high"]) == (5, 1, 0.0, 10.0)
    contrast = summaries.two_group_contrast(df, F.col("g") == "a", ["v"]).first()
    assert contrast["median_v"] == pytest.approx(8.9) and contrast["mean_v_pct"] == pytest.approx(19.9 / 3)
