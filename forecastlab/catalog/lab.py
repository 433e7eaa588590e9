"""Input tables of the pipeline, derived from the given tables by Spark.

``lineitem`` plays the station forecasts, nowcasts and unit production (1995 to 2001), ``supplier``
the units, ``orders`` the market messages and ``events`` an hourly area series. Every row of a source
table is used; the rules are in ``catalog/views.py`` as SQL as well, which is what the oracle reads.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from forecastlab.functions.scalars import add_hours
from forecastlab.operators.reshape import ensemble_long
from forecastlab.session import settle
from forecastlab.sources.schemas import MEMBERS

LOCAL_IDS = [
    "time_ref", "time", "lt", "windpark", "bidding_area", "operating_power_max", "mean_hub_height", "local_relative_power",
]
LOCAL_VARIABLES = ["ws10m", "t2m", "mslp", "g10m"]

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double,"
    "o_orderdate timestamp, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double,"
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string,"
    "l_linestatus string, l_shipdate timestamp",
    "events": "event_id long, ts timestamp, user_id long, event_type string, value double, props string",
}

ISSUE_HOURS = [0, 6, 9, 12, 18]


def _iso(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'")


class Lab:
    """Lazily built input tables over one folder of parquet files."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def units(self) -> DataFrame:
        """Unit table (A5). Ids start at 0; two neighbouring units share a station.

        Settled: the size of a join is only guessed, so Spark would shuffle every forecast to meet the units.
        """
        key = F.col("s_suppkey")
        start = F.lit("1995-01-01").cast("timestamp")
        return settle(
            self.table("supplier")
            .join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .select(
                key.alias("windpark_nve_id"),
                F.col("s_name").alias("windpark_nve"),
                F.concat(F.lit("ST"), F.floor(key / 2).cast("string")).alias("windpark_statnet"),
                F.concat(F.lit("ELSPOT NO"), (F.col("n_regionkey") + 1).cast("string")).alias("bidding_area"),
                F.timestamp_add("DAY", (key * 37 % 2000).cast("int"), start).alias("production_start_date"),
                (10 + key % 90).cast("double").alias("operating_power_max"),
                (1000 + key * 11 % 3000).cast("double").alias("mean_production"),
                (60 + key * 7 % 80).cast("double").alias("mean_hub_height"),
                (70 + key * 3 % 80).cast("double").alias("mean_rotor_diameter"),
                (1 + key % 40).cast("long").alias("num_turbines"),
                (key * 37 % 900).cast("double").alias("elevation"),
                ((key * 17 % 300) / 10).cast("double").alias("ruggedness"),
            ),
            "units",
        )

    @cached_property
    def lookup(self) -> DataFrame:
        return self.units.select(
            "windpark_nve_id", "windpark_nve", "windpark_statnet", "bidding_area",
            F.concat(F.lit("EIC"), F.col("windpark_nve_id").cast("string")).alias("eic_code"),
        )

    @property
    def _forecast_times(self) -> DataFrame:
        return self.table("lineitem").select(
            F.concat(F.lit("ST"), F.floor(F.col("l_suppkey") / 2).cast("string")).alias("sid"),
            add_hours(F.date_trunc("WEEK", "l_shipdate"), 9).alias("time_ref"),
            (15 + 6 * ((F.col("l_orderkey") + F.col("l_linenumber")) % 8)).cast("long").alias("lt"),
            "l_quantity", "l_partkey", "l_discount", "l_tax", "l_linenumber",
        )

    @cached_property
    def _forecast_base(self) -> DataFrame:
        # Dealt by station and issue, so that the windows over lead times find their rows together and no wide row moves for them.
        return (
            self._forecast_times
            .repartition("sid", "time_ref")
            .groupBy("sid", "time_ref", "lt")
            .agg(
                (F.min("l_quantity") / 2).alias("ws"),
                F.min(F.col("l_partkey") * 29 % 360).cast("double").alias("wd"),
                (F.min("l_discount") * 300 - 10).alias("t2"),
                (40 + F.min("l_tax") * 700).alias("rh"),
                (980 + F.min(F.col("l_partkey") % 50)).cast("double").alias("ms"),
                F.min("l_linenumber").cast("double").alias("gust"),
            )
            .select("sid", "time_ref", add_hours("time_ref", "lt").alias("time"), "lt", "ws", "wd", "t2", "rh", "ms", "gust")
        )

    @cached_property
    def forecast_wide(self) -> DataFrame:
        """Ensemble-wide station forecasts (A2): 6 variables of 15 members side by side."""
        return self._side_by_side(self._forecast_base, ["sid", "time_ref", "time", "lt"])

    def site_forecast(self, unit: DataFrame) -> DataFrame:
        """The same at each unit, with the columns of ``unit``: units meet the few columns that members are made from, so no wide row moves for them."""
        base = self._forecast_base.withColumnRenamed("sid", "windpark_statnet").join(unit, "windpark_statnet")
        return self._side_by_side(base, ["windpark_statnet", "time_ref", "time", "lt", *[c for c in unit.columns if c != "windpark_statnet"]])

    @staticmethod
    def _side_by_side(base: DataFrame, kept: list[str]) -> DataFrame:
        columns = []
        for em in MEMBERS:
            speed = F.col("ws") * ((757 + 32 * em) / 1009)
            columns += [
                speed.alias(f"ws10m_{em:02d}"),
                (F.col("wd") + 4.0 * em).alias(f"wd10m_{em:02d}"),
                (F.col("t2") + em / 8).alias(f"t2m_{em:02d}"),
                F.col("rh").alias(f"rh2m_{em:02d}"),
                (F.col("ms") + em / 4).alias(f"mslp_{em:02d}"),
                (speed + F.col("gust")).alias(f"g10m_{em:02d}"),
            ]
        return base.select(*kept, *columns)

    @cached_property
    def calendar(self) -> DataFrame:
        """Issue and valid times of the forecasts: every row of the source is part of one."""
        return self._forecast_times.select("time_ref", add_hours("time_ref", "lt").alias("time")).distinct()

    @cached_property
    def forecast(self) -> DataFrame:
        """Long station forecasts, one row per member."""
        return ensemble_long(
            self.forecast_wide, [F.col("sid").alias("windpark_statnet"), "time_ref", "time", "lt"]
        )

    @cached_property
    def nowcast(self) -> DataFrame:
        """Station nowcasts (A3), daily at 09:00."""
        return (
            self.table("lineitem")
            .groupBy(F.floor(F.col("l_suppkey") / 2).alias("station"), "l_shipdate")
            .agg(
                (F.min("l_discount") * 300 - 10).alias("air_temperature_2m"),
                (980 + F.min(F.col("l_partkey") % 50)).cast("double").alias("air_pressure_at_sea_level"),
                (40 + F.min("l_tax") * 700).alias("relative_humidity_2m"),
                (F.min("l_linenumber") / 2).cast("double").alias("precipitation_amount"),
                (F.max("l_quantity") / 2).alias("wind_speed_10m"),
                F.min(F.col("l_partkey") * 29 % 360).cast("double").alias("wind_direction_10m"),
            )
            .select(
                F.concat(F.lit("ST"), F.col("station").cast("string")).alias("windpark"),
                add_hours("l_shipdate", 9).alias("time"),
                "air_temperature_2m", "air_pressure_at_sea_level", "relative_humidity_2m",
                "precipitation_amount", "wind_speed_10m", "wind_direction_10m",
            )
        )

    @cached_property
    def _production(self) -> DataFrame:
        hours = F.element_at(
            F.array(*[F.lit(h) for h in ISSUE_HOURS]), (F.col("l_orderkey") % 5 + 1).cast("int")
        )
        return self.table("lineitem").select(
            F.col("l_suppkey").alias("windpark_nve_id"),
            add_hours("l_shipdate", hours).alias("time"),
            "l_quantity",
            F.round(F.col("l_quantity") * (1 + F.col("l_tax")) * 100).cast("long").alias("delivered"),
        )

    @cached_property
    def unit_power(self) -> DataFrame:
        """Long unit production (A1)."""
        return self._production.groupBy("windpark_nve_id", "time").agg(F.sum("l_quantity").alias("local_power"))

    @cached_property
    def area_power(self) -> DataFrame:
        """Area production in long form: five slots a day, with holes."""
        area = self.units.select("windpark_nve_id", "bidding_area")
        return (
            self._production.join(area, "windpark_nve_id")
            .groupBy("time", "bidding_area")
            .agg((F.sum("delivered") * 50 / 1009).alias("power"))
        )

    @cached_property
    def hourly(self) -> DataFrame:
        """Hourly area production in long form, from the event stream."""
        kind = F.create_map(
            *[F.lit(x) for pair in zip(
                ["click", "error", "purchase", "signup", "view"], [f"ELSPOT NO{k}" for k in range(1, 6)]
            ) for x in pair]
        )
        return (
            self.table("events")
            .groupBy(F.date_trunc("HOUR", "ts").alias("time"), "event_type")
            .agg((F.sum(F.round(F.col("value") * 100).cast("long")) / 100).alias("power"))
            .select("time", kind[F.col("event_type")].alias("bidding_area"), "power")
        )

    @cached_property
    def hourly_wide(self) -> DataFrame:
        """Area production as landed (A4): one column per area."""
        areas = [f"ELSPOT NO{k}" for k in range(1, 6)]
        return self.hourly.groupBy(F.col("time").alias("__index_level_0__")).pivot("bidding_area", areas).agg(
            F.first("power")
        )

    @cached_property
    def local_pred_wide(self) -> DataFrame:
        """Predictions of started units, the members side by side."""
        unit = self.units.select(
            "windpark_statnet", F.col("windpark_nve").alias("windpark"), "bidding_area",
            "operating_power_max", "production_start_date",
        )
        power = [(F.col("operating_power_max") * F.least(F.col(f"ws10m_{em:02d}") / 30, F.lit(1.0))).alias(f"local_power_pred_{em:02d}") for em in MEMBERS]
        sites = self.site_forecast(unit).filter(F.col("time_ref") > F.col("production_start_date"))
        return sites.select("time_ref", "time", "lt", "windpark", "bidding_area", *power)

    @cached_property
    def local_pred(self) -> DataFrame:
        """The same, one row per member, opened after the units met the rows of all members."""
        return ensemble_long(self.local_pred_wide, ["time_ref", "time", "lt", "windpark", "bidding_area"], ["local_power_pred"])

    @cached_property
    def local_cells(self) -> DataFrame:
        """Forecasts of all members at started units with their production where known.

        Not written: most readers want a few of the columns, and predictions don't want the production, so each leaves out what it doesn't read.
        """
        unit = self.units.select(
            "windpark_statnet", "windpark_nve_id", F.col("windpark_nve").alias("windpark"), "bidding_area",
            "operating_power_max", "mean_hub_height", "production_start_date",
        )
        cells = (
            self._forecast_base.withColumnRenamed("sid", "windpark_statnet").join(unit, "windpark_statnet")
            .filter(F.col("time_ref") > F.col("production_start_date"))
            .join(self.unit_power, ["windpark_nve_id", "time"], "left")
        )
        cells = cells.withColumn("local_relative_power", F.col("local_power") / F.col("operating_power_max"))
        kept = [f"{v}_{em:02d}" for v in LOCAL_VARIABLES for em in MEMBERS]
        return self._side_by_side(cells, LOCAL_IDS).select(*LOCAL_IDS, *kept)

    @cached_property
    def local_rows(self) -> DataFrame:
        """One row per member, unit and time."""
        return ensemble_long(self.local_cells, LOCAL_IDS, LOCAL_VARIABLES)

    @cached_property
    def first_rows(self) -> DataFrame:
        """Member 0 alone where the target is known, chosen before the members become rows: what models are trained on.

        Settled, because month starts and fits read it.
        """
        known = self.local_cells.filter(F.col("local_relative_power").isNotNull())
        return settle(ensemble_long(known, LOCAL_IDS, LOCAL_VARIABLES, members=[0]), "first_rows")

    @property
    def local_table(self) -> DataFrame:
        """The local data set with all features."""
        from forecastlab.plans.local import local_dataset

        forecast = self.forecast_wide.withColumnRenamed("sid", "windpark_statnet")
        return local_dataset(self.units, self.unit_power, forecast, self.nowcast, self.outages, calendar=self.calendar)

    @cached_property
    def messages(self) -> DataFrame:
        """Nested market messages (A7), one per order."""
        key, cust = F.col("o_orderkey"), F.col("o_custkey")
        published = add_hours("o_orderdate", (key % 24))
        day = F.timestamp_add("DAY", F.lit(1), F.col("o_orderdate"))

        def period(j: int) -> Column:
            start = add_hours(day, key % 4 * 6 + 48 * j)
            stop = add_hours(start, (1 + key % 5) * 12)
            installed = (50 + cust % 50).cast("double")
            lost = (10 + (cust + j) % 40).cast("double")
            return F.struct(
                lost.alias("unavailableCapacity"), (installed - lost).alias("availableCapacity"),
                _iso(start).alias("eventStart"), _iso(stop).alias("eventStop"),
            )

        periods = F.slice(F.array(period(0), period(1)), 1, (1 + F.floor(key / 2) % 2).cast("int"))

        def unit(j: int) -> Column:
            park = (F.floor(cust / 15) + j).cast("string")
            return F.struct(
                F.concat(F.lit("Unit "), park).alias("name"), F.concat(F.lit("EIC"), park).alias("eic"),
                F.lit(19).alias("fuelType"), F.lit("").alias("areaEic"), F.lit("").alias("areaName"),
                (50 + cust % 50).cast("double").alias("installedCapacity"), periods.alias("timePeriods"),
            )

        units = F.slice(F.array(unit(0), unit(1)), 1, (1 + key % 2).cast("int"))
        line = F.array(
            F.struct(
                F.lit("").alias("inAreaEic"), F.concat(F.lit("NO"), ((cust + 1) % 6 + 1).cast("string")).alias("inAreaName"),
                F.lit("").alias("outAreaEic"), F.concat(F.lit("NO"), (cust % 6 + 1).cast("string")).alias("outAreaName"),
                (50 + cust % 50).cast("double").alias("installedCapacity"), periods.alias("timePeriods"),
            )
        )
        areas = F.slice(
            F.array(*[
                F.struct(F.concat(F.lit("NO"), ((cust + j) % 6 + 1).cast("string")).alias("name"), F.lit("").alias("code"))
                for j in (0, 1)
            ]), 1, (1 + key % 2).cast("int"),
        )
        park = F.floor(cust / 15)
        asset = F.array(
            F.struct(
                F.when(key % 3 == 0, F.concat(F.lit("Supplier#"), F.lpad(park.cast("string"), 9, "0")))
                .when(key % 3 == 1, F.concat(F.lit("ST"), F.floor(park / 2).cast("string"))).alias("name"),
                F.when(key % 5 != 0, F.concat(F.lit("EIC"), (park + key % 2).cast("string"))).alias("code"),
            )
        )
        kind = (
            F.when(F.col("o_orderpriority").isin("1-URGENT", "4-NOT SPECIFIED"), 1)
            .when(F.col("o_orderpriority").isin("2-HIGH", "5-LOW"), 3)
            .otherwise(5)
        )
        generation = key % 7 == 0
        return self.table("orders").select(
            F.concat(F.lit("M"), key.cast("string")).alias("messageId"),
            kind.alias("messageType"),
            (1 + key % 2).cast("int").alias("unavailabilityType"),
            F.lit("").alias("reasonCode"), F.lit("").alias("unavailabilityReason"),
            F.col("o_orderpriority").alias("remarks"),
            _iso(published).alias("publicationDate"),
            F.lit("").alias("publisherId"), F.lit("").alias("publisherName"),
            _iso(day).alias("eventStart"), _iso(add_hours(day, 24)).alias("eventStop"),
            F.when((kind == 1) & ~generation, units).alias("productionUnits"),
            F.when((kind == 1) & generation, units).alias("generationUnits"),
            F.when(kind == 3, line).alias("transmissionUnits"),
            F.when(kind == 5, areas).alias("areas"),
            F.when((kind == 5) & (key % 4 != 0), asset).alias("assets"),
        )

    @cached_property
    def pages(self) -> DataFrame:
        """Messages as landed: pages of at most 100 with the announced total."""
        columns = self.messages.columns
        total = self.table("orders").agg(F.count(F.lit(1))).scalar()
        keyed = self.messages.withColumn("_page", F.floor(F.substring("messageId", 2, 20).cast("long") / 100))
        return (
            keyed.groupBy("_page").agg(F.collect_list(F.struct(*columns)).alias("items"))
            .select(total.alias("total"), "items")
        )

    @cached_property
    def outages(self) -> DataFrame:
        """Production outages with the unit id from the lookup."""
        from forecastlab.sources.messages import production_outages

        lookup = self.lookup.select("windpark_nve_id", "eic_code")
        return production_outages(self.messages).join(lookup, F.col("eic") == F.col("eic_code")).drop("eic", "eic_code")

    @cached_property
    def transmission(self) -> DataFrame:
        from forecastlab.sources.messages import transmission_outages

        return transmission_outages(self.messages, after="1995-06-01")

    @cached_property
    def register(self) -> DataFrame:
        """Installations as registered (A8): every eleventh lacks a hub height."""
        key = F.col("windpark_nve_id")
        turbines = F.array(
            F.struct(F.lit("A").alias("TurbinType"), (2000 + key % 10 * 100).cast("double").alias("TurbinStorrelse_kW"),
                     (1 + key % 7).alias("AntallTurbiner")),
            F.struct(F.concat(F.lit("B"), (key % 3).cast("string")).alias("TurbinType"),
                     (3000 + key % 5 * 100).cast("double").alias("TurbinStorrelse_kW"), (key % 4).alias("AntallTurbiner")),
        )
        return self.units.select(
            key.alias("VindkraftAnleggId"), F.col("windpark_nve").alias("Navn"),
            _iso(F.col("production_start_date")).alias("IdriftsettelseForsteByggetrinn"),
            F.col("operating_power_max").alias("InstallertEffekt_MW"),
            F.col("bidding_area").alias("Fylke"), F.col("windpark_statnet").alias("Kommune"),
            F.when(key % 11 != 0, F.col("mean_hub_height")).alias("GjsnittNavhoeyde"),
            F.col("mean_production").alias("GjsnittGeneratorytelse"),
            F.col("mean_rotor_diameter").alias("GjsnittRotordiameter"),
            F.col("num_turbines").alias("AntallOperativeTurbiner"),
            turbines.alias("Turbiner"),
        )

    @cached_property
    def raster(self) -> DataFrame:
        key = F.col("p_partkey")
        return self.table("part").select(
            (key % 40).alias("ix"), F.floor(key / 40).alias("iy"), F.col("p_retailprice").alias("value")
        )

    @cached_property
    def points(self) -> DataFrame:
        """Units on the raster: a few lie beyond its edge."""
        key = F.col("s_suppkey")
        return self.table("supplier").select(
            key.alias("windpark_nve_id"),
            ((key * 7 % 164) / 4).alias("x"), ((key * 11 % 100) / 8).alias("y"),
        )
