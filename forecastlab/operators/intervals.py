"""As-known interval joins: a message counts at ``(time_ref, time)`` when it was published before
the issue time and its period covers the valid time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

PUBLISHED, START, STOP = "publicationDate", "eventStart", "eventStop"


def covers(time_ref: Column | str = "time_ref", time: Column | str = "time") -> Column:
    """Publication strictly before issue, period bounds inclusive."""
    time_ref = F.col(time_ref) if isinstance(time_ref, str) else time_ref
    time = F.col(time) if isinstance(time, str) else time
    return (time_ref > F.col(PUBLISHED)) & (time >= F.col(START)) & (time <= F.col(STOP))


def visible_pairs(rows: DataFrame, events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each row with each message it can see.

    The range condition becomes an equi-join on the day, so Spark shuffles by ``(key, day)`` and AQE
    can split a hot day; the exact bounds are checked on what meets.
    """
    by_day = rows.withColumn("_day", F.to_date("time"))
    spread = events.filter(F.col(STOP) >= F.col(START)).withColumn(
        "_day", F.explode(F.sequence(F.to_date(START), F.to_date(STOP), F.expr("INTERVAL 1 DAY")))
    )
    return by_day.join(spread, [*keys, "_day"]).filter(covers()).drop("_day")


def covered_hours(events: DataFrame, hours: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each message at each of the asked ``hours`` (a distinct column ``time``) that it covers.

    Messages are few but long, so they are spread over the tasks before they are opened to hours. An hour that
    nobody asks for is dropped in the task that makes it.
    """
    first_hour = F.when(F.col(START) == F.date_trunc("HOUR", F.col(START)), F.col(START)).otherwise(
        F.timestamp_add("HOUR", F.lit(1), F.date_trunc("HOUR", F.col(START)))
    )
    return (
        events.withColumns({"_from": first_hour, "_to": F.date_trunc("HOUR", F.col(STOP))})
        .filter(F.col("_from") <= F.col("_to"))
        .repartition(*keys, START, PUBLISHED)
        .withColumn("time", F.explode(F.expr("sequence(_from, _to, INTERVAL 1 HOUR)")))
        .join(F.broadcast(hours), "time", "left_semi")
    )


def covered_cells(events: DataFrame, calendar: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The ``(keys, time_ref, time)`` of a settled calendar that may see a message: all others see none, whatever grid they are in.

    Each key and hour is listed once before it meets the issue times.
    """
    seen = F.min(PUBLISHED).alias("_first")
    hours = covered_hours(events, calendar.select("time").distinct(), keys).groupBy(*keys, "time").agg(seen)
    return hours.join(calendar.select("time_ref", "time"), "time").filter(F.col("time_ref") > F.col("_first")).select(*keys, "time_ref", "time")


def visible_totals(
    rows: DataFrame, events: DataFrame, keys: Sequence[str], sums: Sequence[str], flags: Sequence[str] = ()
) -> DataFrame:
    """Sums (and any-of flags) over the visible messages of each ``(keys, time_ref, time)``.

    No row-message pair is made. A message is spread over the asked hours it covers and added up per
    ``(key, hour, first hour it is visible)`` before the shuffle; a running sum along the visible
    hour, with the issue times sorted in between, then answers every row. Hours that no row asks for
    are dropped as they are made, so they are never shuffled; the list of asked hours grows with the
    calendar. ``rows`` are read twice for that, so hand in a settled table. Issue and valid times must
    be whole hours; a row that is not raises an error instead of giving a wrong sum. Rows that see
    no message are absent.
    """
    totals = {s: F.sum(s).alias(s) for s in sums}
    totals |= {f: F.sum(F.col(f).cast("long")).alias(f) for f in flags}
    known = (
        covered_hours(events, rows.select("time").distinct(), keys)
        .groupBy(
            *keys, "time",
            F.timestamp_add("HOUR", F.lit(1), F.date_trunc("HOUR", F.col(PUBLISHED))).alias("_at"),
        )
        .agg(*totals.values(), F.count(F.lit(1)).alias("_seen"))
        .withColumn("_ask", F.lit(0))
    )
    whole = (F.col("time") == F.date_trunc("HOUR", "time")) & (
        F.col("time_ref") == F.date_trunc("HOUR", "time_ref")
    )
    asked_at = F.when(whole, F.col("time_ref")).otherwise(
        F.raise_error(F.lit("visible_totals needs whole hours; use visible_pairs")).cast("timestamp")
    )
    asked = (
        rows.select(*keys, "time_ref", "time").distinct()
        .select(*keys, "time", asked_at.alias("_at"), F.lit(1).alias("_ask"))
    )
    names = [*sums, *flags]
    merged = asked.unionByName(known, allowMissingColumns=True)
    before = (
        Window.partitionBy(*keys, "time").orderBy("_at", "_ask").rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        merged.withColumns({c: F.sum(c).over(before) for c in [*names, "_seen"]})
        .filter((F.col("_ask") == 1) & (F.col("_seen") > 0))
        .select(
            *keys, F.col("_at").alias("time_ref"), "time",
            *[F.coalesce(F.col(s), F.lit(0.0)).alias(s) for s in sums],
            *[(F.coalesce(F.col(f), F.lit(0)) > 0).alias(f) for f in flags],
        )
    )
