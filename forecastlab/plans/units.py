"""Unit table: lookup, register, geography and highest observed output."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from forecastlab.operators.ranks import first_per_key
from forecastlab.operators.reshape import bilinear

# Register names that differ from the production file.
RENAMED = {
    "Nye Sandøy": "Sandøy",
    "Valsneset vindkraftverk": "Valsneset",
    "Raggovidda 2": "Raggovidda",
}


def observed_maximum(unit_power: DataFrame) -> DataFrame:
    return unit_power.groupBy("windpark_nve_id").agg(F.max("local_power").alias("actual_max_output"))


def observed_capacity(units: DataFrame, unit_power: DataFrame) -> DataFrame:
    """Capacity raised to the highest observed output; ``greatest`` passes over a missing one."""
    return (
        units.join(observed_maximum(unit_power), "windpark_nve_id", "left")
        .withColumn("reported_operating_power_max", F.col("operating_power_max"))
        .withColumn("operating_power_max", F.greatest("operating_power_max", "actual_max_output"))
        .drop("actual_max_output")
    )


def unit_sites(geo: DataFrame, lookup: DataFrame, names: dict[str, str] = RENAMED) -> DataFrame:
    """One site per unit: named sites met with the lookup, an entry without a start date first.

    ``geo`` has ``site_name, started, x, y``. Sorting the flag ascending keeps the entry that has no
    start date when both exist.
    """
    one_name = first_per_key(
        lookup.select("windpark_nve_id", "windpark_nve"), ["windpark_nve_id"], ["windpark_nve"]
    ).replace(names, subset=["windpark_nve"])
    met = geo.join(one_name, F.col("site_name") == F.col("windpark_nve"))
    flagged = met.withColumn("has_start_date", F.col("started").isNotNull())
    return first_per_key(
        flagged.select("windpark_nve_id", "has_start_date", "x", "y"),
        ["windpark_nve_id"], ["has_start_date", "x", "y"],
    )


def site_features(sites: DataFrame, elevation: DataFrame, ruggedness: DataFrame) -> DataFrame:
    """Raster values at the sites; ruggedness outside its raster (at sea) is 0."""
    high = bilinear(sites, elevation, "windpark_nve_id").withColumnRenamed("value", "elevation")
    rough = bilinear(sites, ruggedness, "windpark_nve_id", fill=0.0).withColumnRenamed("value", "ruggedness")
    return high.join(rough, "windpark_nve_id")


def enriched_units(lookup: DataFrame, register: DataFrame, geo: DataFrame, unit_power: DataFrame) -> DataFrame:
    """Unit table for the data sets, one row per unit of the lookup.

    ``register`` has the columns of ``read_register``; ``geo`` has ``windpark_nve_id, elevation,
    ruggedness``.
    """
    one_entry = first_per_key(
        lookup.select("windpark_nve_id", "windpark_nve", "windpark_statnet", "bidding_area"),
        ["windpark_nve_id"], ["windpark_nve"],
    )
    joined = (
        one_entry.join(register, "windpark_nve_id", "left")
        .join(geo, "windpark_nve_id", "left")
    )
    return observed_capacity(joined, unit_power).select(
        "windpark_nve_id", "windpark_nve", "windpark_statnet", "bidding_area", "province", "county",
        "production_start_date", "reported_operating_power_max", "operating_power_max", "mean_hub_height",
        "mean_production", "mean_rotor_diameter", "num_turbines", "elevation", "ruggedness",
    )


def turbine_effect(register_raw: DataFrame, unit_power: DataFrame) -> DataFrame:
    """Capacity added up from the nested turbine list, beside the reported and the observed one."""
    effect = F.sum(F.col("turbine.TurbinStorrelse_kW") * F.col("turbine.AntallTurbiner")) / 1000.0
    return (
        register_raw.select("Navn", "VindkraftAnleggId", "InstallertEffekt_MW", F.explode_outer("Turbiner").alias("turbine"))
        .groupBy("Navn", "VindkraftAnleggId", "InstallertEffekt_MW")
        .agg(effect.alias("sum_effect"))
        .join(observed_maximum(unit_power), F.col("VindkraftAnleggId") == F.col("windpark_nve_id"), "left")
        .select("Navn", "VindkraftAnleggId", "InstallertEffekt_MW", "sum_effect", F.col("actual_max_output").alias("max_output"))
    )
