"""Readers and sinks for the file formats of the pipeline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from forecastlab.functions.scalars import decimal_comma
from forecastlab.sources import schemas


def read_parquet(spark: SparkSession, path: str | list[str], schema: str | T.StructType | None = None) -> DataFrame:
    """Lazy columnar scan; the declared schema keeps footers from being read for inference."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*([path] if isinstance(path, str) else path))


def read_parquet_extended(
    spark: SparkSession, history: str, extension: str | None, schema: str | T.StructType | None = None
) -> DataFrame:
    """History plus optional later files (a glob), matched by column name."""
    base = read_parquet(spark, history, schema)
    if extension is None:
        return base
    return base.unionByName(read_parquet(spark, extension, base.schema))


def read_text_csv(spark: SparkSession, path: str, columns: Sequence[str], sep: str = ";") -> DataFrame:
    """Delimited file with every column as text; numbers are cast by the caller."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.option("sep", sep).option("header", True).schema(schema).csv(path)


def csv_header(spark: SparkSession, path: str, sep: str = ";") -> list[str]:
    """Column names of a delimited file, read from its first line only."""
    return spark.read.option("sep", sep).option("header", True).csv(path).columns


def read_csv_like(spark: SparkSession, path: str, schema: str | T.StructType, null_value: str = "NA") -> DataFrame:
    """Comma file typed by the schema of a sibling table, with a text marker for missing."""
    return spark.read.schema(schema).option("header", True).option("nullValue", null_value).csv(path)


def read_csv_dates(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Comma file with ISO timestamps."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]")
        .csv(path)
    )


def read_units(spark: SparkSession, path: str) -> DataFrame:
    return read_csv_dates(spark, path, schemas.UNITS)


def read_lookup(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Key lookup, cut to some columns and de-duplicated."""
    return spark.read.schema(schemas.LOOKUP).option("header", True).csv(path).select(*columns).distinct()


def split_second_header(raw: DataFrame, time_col: str = "time") -> tuple[DataFrame, DataFrame]:
    """Separate the row of column ids from the measurements below it.

    The id row is the one whose ``time`` is not a time. Found by content, not by position: a split of
    the file has no notion of a first row.
    """
    is_time = F.try_to_timestamp(F.col(time_col), F.lit("yyyy-MM-dd HH:mm:ss")).isNotNull()
    names = [c for c in raw.columns if c != time_col]
    ids = (
        raw.filter(~is_time)
        .unpivot([], names, "windpark_nve", "id_text")
        .select("windpark_nve", F.expr("try_cast(id_text AS BIGINT)").alias("windpark_nve_id"))
    )
    return ids, raw.filter(is_time)


def read_unit_power(
    spark: SparkSession, path: str, after: str = "2020-01-01", offset_hours: int = 1
) -> DataFrame:
    """Unit production: ``;`` separated, decimal comma, second header row of ids, clock at UTC+1."""
    raw = read_text_csv(spark, path, csv_header(spark, path))
    return unit_power_long(raw, after, offset_hours)


def unit_power_long(raw: DataFrame, after: str = "2020-01-01", offset_hours: int = 1) -> DataFrame:
    ids, rows = split_second_header(raw)
    names = [c for c in raw.columns if c != "time"]
    local_time = F.to_timestamp("time", "yyyy-MM-dd HH:mm:ss")
    return (
        rows.select(
            F.timestamp_add("HOUR", F.lit(-offset_hours), local_time).alias("time"),
            *[decimal_comma(f"`{c}`").cast("float").alias(c) for c in names],
        )
        .filter(F.col("time") > F.lit(after).cast("timestamp"))
        .unpivot("time", names, "windpark_nve", "local_power")
        .dropna("any")
        .join(ids, "windpark_nve")
    )


def read_register(spark: SparkSession, path: str, one_array: bool = True) -> DataFrame:
    """JSON array of installations, with the register's column names mapped to ours.

    ``one_array=False`` reads files with one array per line, which Spark can split.
    """
    reader = spark.read.schema(schemas.REGISTER).option("multiLine", one_array)
    return register_columns(reader.json(path))


def register_columns(raw: DataFrame) -> DataFrame:
    mean_height = raw.agg(F.avg("GjsnittNavhoeyde")).scalar()
    return raw.select(
        F.col("VindkraftAnleggId").alias("windpark_nve_id"),
        F.expr("try_cast(IdriftsettelseForsteByggetrinn AS TIMESTAMP)").alias("production_start_date"),
        F.col("InstallertEffekt_MW").alias("operating_power_max"),
        F.col("Fylke").alias("province"),
        F.col("Kommune").alias("county"),
        F.coalesce("GjsnittNavhoeyde", mean_height).alias("mean_hub_height"),
        F.col("GjsnittGeneratorytelse").alias("mean_production"),
        F.col("GjsnittRotordiameter").alias("mean_rotor_diameter"),
        F.col("AntallOperativeTurbiner").alias("num_turbines"),
    )


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), sort_by: Sequence[str] = ()) -> None:
    """Sorted data set without a single-task sort: range partitions, each sorted on its own."""
    if sort_by:
        df = df.repartitionByRange(*sort_by).sortWithinPartitions(*sort_by)
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_best_params(trials: DataFrame, path: str) -> None:
    """Append the best of each study's trials ``(study, params map<string,string>, rmse)``."""
    best = trials.groupBy("study").agg(
        F.min_by("params", F.struct("rmse", F.map_entries("params"))).alias("params"), F.min("rmse").alias("rmse")
    )
    best.write.mode("append").parquet(path)


def read_best_params(spark: SparkSession, path: str, study: str | None = None) -> DataFrame:
    """Stored parameters; the lowest error wins when a study was tuned more than once."""
    stored = spark.read.schema("study string, params map<string,string>, rmse double").parquet(path)
    if study is not None:
        stored = stored.filter(F.col("study") == study)
    return stored.groupBy("study").agg(F.min_by("params", "rmse").alias("params"), F.min("rmse").alias("rmse"))
