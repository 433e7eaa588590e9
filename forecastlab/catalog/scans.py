"""Sources and sinks (survey 2.1): each writes a file Spark derives from the tables and reads it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from forecastlab.catalog.lab import SCHEMAS, Lab
from forecastlab.catalog.registry import check
from forecastlab.functions.scalars import add_hours, decimal_comma
from forecastlab.session import scratch_path
from forecastlab.sources import files, messages, schemas

AREAS = [f"ELSPOT NO{k}" for k in range(1, 6)]


def _landed(lab: Lab, df: DataFrame, label: str, form: str = "csv", **options) -> str:
    path = scratch_path(lab.spark, label)
    df.write.options(**options).format(form).save(path)
    return path


def _production_text(lab: Lab) -> str:
    """Area production as a text file: decimal comma, UTC+1 clock, a second header row of ids."""
    wide = lab.area_power.groupBy("time").pivot("bidding_area", AREAS).agg(F.first("power"))
    text = [
        F.replace(F.col(f"`{a}`").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(",")).alias(a)
        for a in AREAS
    ]
    rows = wide.select(F.date_format(add_hours("time", 1), "yyyy-MM-dd HH:mm:ss").alias("time"), *text)
    ids = lab.units.agg(
        F.lit("id").alias("time"),
        *[F.min(F.when(F.col("bidding_area") == a, F.right("bidding_area", F.lit(1)))).alias(a) for a in AREAS],
    )
    return _landed(lab, ids.unionByName(rows), "production", sep=";", header=True)


@check("src_csv_decimal_comma", """
SELECT strftime(time + INTERVAL '1' HOUR, '%Y-%m-%d %H:%M:%S') AS time, bidding_area, round(power, 2) AS power
FROM v_area_power""")
def _(lab):
    path = _production_text(lab)
    raw = files.read_text_csv(lab.spark, path, ["time", *AREAS])
    return (
        raw.filter(F.col("time") != "id")
        .select("time", *[decimal_comma(f"`{a}`").alias(a) for a in AREAS])
        .unpivot("time", AREAS, "bidding_area", "power")
        .dropna()
        .withColumn("power", F.round("power", 2))
    )


@check("src_second_header_row", """
SELECT p.time, p.bidding_area AS windpark_nve, round(p.power, 2) AS local_power,
       CAST(right(p.bidding_area, 1) AS BIGINT) AS windpark_nve_id
FROM v_area_power p
WHERE p.time > TIMESTAMP '1995-06-01 00:00:00' AND p.bidding_area IN (SELECT bidding_area FROM v_units)""")
def _(lab):
    path = _production_text(lab)
    long = files.unit_power_long(files.read_text_csv(lab.spark, path, ["time", *AREAS]), after="1995-06-01")
    return long.select(
        "time", "windpark_nve", F.round(F.col("local_power").cast("double"), 2).alias("local_power"), "windpark_nve_id"
    )


MEMBER_COLUMNS = [c for c in schemas.names(schemas.FORECAST_WIDE) if c not in ("sid", "time_ref", "time", "lt", "ws10m_00")]


@check("src_csv_typed_na", "SELECT sid, time_ref, time, lt, CASE WHEN lt <> 15 THEN round(ws10m_00, 6) END AS ws10m_00, "
       + ", ".join(f"round({c}, 6) AS {c}" for c in MEMBER_COLUMNS) + " FROM v_forecast_wide")
def _(lab):
    wide = lab.forecast_wide.withColumn("ws10m_00", F.when(F.col("lt") != 15, F.col("ws10m_00")))
    ordered = wide.select(*schemas.names(schemas.FORECAST_WIDE))
    # Text of 90 numbers a row is several times their binary size: it is landed compressed, in files small enough to be read side by side.
    path = _landed(lab, ordered, "forecast", header=True, nullValue="NA", compression="gzip", maxRecordsPerFile=200_000)
    typed = files.read_csv_like(lab.spark, path, schemas.FORECAST_WIDE)
    return typed.select("sid", "time_ref", "time", "lt", *[F.round(c, 6).alias(c) for c in ("ws10m_00", *MEMBER_COLUMNS)])


@check("src_csv_dates", """
SELECT windpark_nve_id, windpark_nve, windpark_statnet, bidding_area, production_start_date, operating_power_max,
       mean_hub_height, num_turbines, elevation, round(ruggedness, 6) AS ruggedness, 'Åfjord, ' || windpark_nve AS county
FROM v_units""")
def _(lab):
    full = lab.units.withColumns(
        {
            "province": F.lit("P"),
            "county": F.concat(F.lit("Åfjord, "), "windpark_nve"),
            "reported_operating_power_max": F.col("operating_power_max"),
        }
    ).select(*schemas.names(schemas.UNITS))
    path = _landed(lab, full, "units", header=True, timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return files.read_units(lab.spark, path).select(
        "windpark_nve_id", "windpark_nve", "windpark_statnet", "bidding_area", "production_start_date",
        "operating_power_max", "mean_hub_height", "num_turbines", "elevation",
        F.round("ruggedness", 6).alias("ruggedness"), "county",
    )


@check("src_csv_lookup", "SELECT windpark_nve_id, eic_code FROM v_lookup")
def _(lab):
    twice = lab.lookup.unionAll(lab.lookup)
    path = _landed(lab, twice, "lookup", header=True)
    return files.read_lookup(lab.spark, path, ["windpark_nve_id", "eic_code"])


@check("src_parquet", f"SELECT {', '.join(schemas.names(SCHEMAS['lineitem']))} FROM lineitem")
def _(lab):
    return files.read_parquet(lab.spark, f"{lab.sf_dir}/lineitem.parquet", SCHEMAS["lineitem"])


@check("src_parquet_extend", "SELECT windpark, time, wind_speed_10m, wind_direction_10m FROM v_nowcast")
def _(lab):
    late = F.col("time") >= F.lit("2000-01-01").cast("timestamp")
    base = scratch_path(lab.spark, "nowcast")
    lab.nowcast.filter(~late).write.parquet(f"{base}/history")
    lab.nowcast.filter(late).write.parquet(f"{base}/daily/first")
    both = files.read_parquet_extended(lab.spark, f"{base}/history", f"{base}/daily/*", schemas.NOWCAST)
    return both.select("windpark", "time", "wind_speed_10m", "wind_direction_10m")


@check("src_json_pages", """
SELECT messageId, messageType, publicationDate, true AS complete FROM v_message""")
def _(lab):
    path = _landed(lab, lab.pages, "pages", "json")
    pages = messages.read_pages(lab.spark, path)
    complete = messages.page_completeness(pages).select("complete").scalar()
    return messages.page_items(pages).select(
        "messageId", "messageType", messages.as_time("publicationDate").alias("publicationDate"),
        complete.alias("complete"),
    )


@check("src_json_records", """
SELECT windpark_nve_id, production_start_date, operating_power_max, bidding_area AS province, windpark_statnet AS county,
       round(coalesce(hub, (SELECT avg(hub) FROM v_register)), 6) AS mean_hub_height, mean_production,
       mean_rotor_diameter, num_turbines
FROM v_register""")
def _(lab):
    records = F.collect_list(F.struct(*lab.register.columns))
    lines = lab.register.groupBy(F.floor(F.col("VindkraftAnleggId") / 100)).agg(F.to_json(records).alias("value"))
    path = _landed(lab, lines.select("value"), "register", "text")
    return files.read_register(lab.spark, path, one_array=False).withColumn(
        "mean_hub_height", F.round("mean_hub_height", 6)
    )


@check("sink_parquet", "SELECT time, bidding_area, round(power, 6) AS power FROM v_area_power")
def _(lab):
    path = scratch_path(lab.spark, "sink")
    files.write_parquet(lab.area_power, path, partition_by=["bidding_area"], sort_by=["bidding_area", "time"])
    return lab.spark.read.schema("time timestamp, power double, bidding_area string").parquet(path).select(
        "time", "bidding_area", F.round("power", 6).alias("power")
    )


@check("sink_csv", "SELECT windpark_nve_id, windpark_nve, bidding_area, operating_power_max FROM v_units")
def _(lab):
    path = scratch_path(lab.spark, "sink")
    columns = ["windpark_nve_id", "windpark_nve", "bidding_area", "operating_power_max"]
    files.write_csv(lab.units.select(*columns), path)
    schema = "windpark_nve_id long, windpark_nve string, bidding_area string, operating_power_max double"
    return lab.spark.read.option("header", True).schema(schema).csv(path)


@check("sink_best_params", """
SELECT bidding_area AS study, min(elevation) / 900 AS rmse,
       arg_min(CAST(num_turbines AS VARCHAR), elevation * 100000000 + windpark_nve_id) AS max_depth
FROM v_units GROUP BY 1""")
def _(lab):
    trials = lab.units.select(
        F.col("bidding_area").alias("study"),
        F.create_map(
            F.lit("id"), F.lpad(F.col("windpark_nve_id").cast("string"), 12, "0"),
            F.lit("max_depth"), F.col("num_turbines").cast("string"),
        ).alias("params"),
        (F.col("elevation") / 900).alias("rmse"),
    )
    path = scratch_path(lab.spark, "params")
    files.write_best_params(trials, path)
    return files.read_best_params(lab.spark, path).select("study", "rmse", F.col("params")["max_depth"].alias("max_depth"))
