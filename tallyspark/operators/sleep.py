"""Nights from sleep fragments, and average clock times.

Grouping and the hour test use the wall clock of the record; durations use instants.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import (
    circular_mean_seconds,
    clock_text,
    date_parts,
    floor_minute,
    iso_week,
    seconds_of_day,
)
from tallyspark.functions.clock import DAY

KEYS = ("user",)

# Wake-up hours that are not a real morning, and the targets.
IMPLAUSIBLE_WAKE_HOURS = (0, 1, 2, 3, 22, 23)
WAKE_TARGET = 6 * 3600
BED_TARGET = 22 * 3600
DURATION_TARGET = 8 * 3600 + 30 * 60
SLEEP_NAMES = ("Wake", "Bed", "Duration")


def sleep_nights(records: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One night per date of waking: first start, last end, plausible wake-ups only.

    A plain aggregation with fixed-width buffers, in place of a partition-wide
    minimum and maximum followed by a dedupe.
    """
    nights = (
        records.withColumn("end_date", F.to_date("end_wall"))
        .dropna(subset=[*keys, "end_date"])
        .groupBy(*keys, "end_date")
        .agg(
            F.min("sleep_start").alias("first_start"),
            F.min_by("start_wall", "sleep_start").alias("bedtime"),
            F.max("sleep_end").alias("last_end"),
            F.max_by("end_wall", "sleep_end").alias("wakeup"),
        )
    )
    return nights.where(~F.hour("wakeup").isin(*IMPLAUSIBLE_WAKE_HOURS)).select(
        *keys,
        # The date of waking is the grouping key, so filters on its parts move below the grouping.
        *date_parts("end_date", "year", "month"),
        iso_week("end_date").alias("week"),
        "bedtime",
        "wakeup",
        F.timestamp_diff("SECOND", F.col("first_start"), F.col("last_end")).alias(
            "duration_seconds"
        ),
    )


def format_sleep(nights: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Wake, Bed and Duration rows in whole minutes of the day, with their targets."""

    def minute(seconds: Column, name: str) -> Column:
        return floor_minute(seconds.cast("bigint")).alias(name)

    target = (
        F.when(F.col("name") == "Bed", BED_TARGET)
        .when(F.col("name") == "Duration", DURATION_TARGET)
        .otherwise(WAKE_TARGET)
    )
    ids = [*keys, "year", "month", "week_number"]
    return (
        nights.withColumnRenamed("week", "week_number")
        .select(
            *ids,
            minute(seconds_of_day(F.col("wakeup")), "Wake"),
            minute(seconds_of_day(F.col("bedtime")), "Bed"),
            minute(F.pmod("duration_seconds", F.lit(DAY)), "Duration"),
        )
        .unpivot(ids, list(SLEEP_NAMES), "name", "tod_seconds")
        .withColumn("target_seconds", target.cast("bigint"))
        .withColumn("positive", F.col("name") == "Duration")
    )


def mean_of_day(name: Column, tod_seconds: Column) -> Column:
    """Circular mean of clock times; plain mean, whole seconds, of durations."""
    return F.when(name == "Duration", F.floor(F.avg(tod_seconds))).otherwise(
        circular_mean_seconds(tod_seconds)
    )


def avg_time_of_day(formatted: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Circular mean of wake and bed times."""
    return (
        formatted.where(F.col("name") != "Duration")
        .groupBy(*keys, "name")
        .agg(circular_mean_seconds(F.col("tod_seconds")).alias("tod_seconds"))
        .withColumn("value", clock_text(F.col("tod_seconds")))
    )


def avg_duration(formatted: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean duration as clock text; it wraps at 24 hours."""
    return (
        formatted.where(F.col("name") == "Duration")
        .groupBy(*keys)
        .agg(F.floor(F.avg("tod_seconds")).alias("tod_seconds"))
        .withColumn("value", clock_text(F.col("tod_seconds")))
    )


def avg_sleep(formatted: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Average of each sleep row kind next to its target.

    Target and direction follow from the name, so they ride along as grouping
    columns where a join of targets and averages would shuffle twice.
    """
    return (
        formatted.dropna(subset=list(keys))
        .groupBy(*keys, "name", "target_seconds", "positive")
        .agg(mean_of_day(F.col("name"), F.col("tod_seconds")).alias("tod_seconds"))
        .withColumn("value", clock_text(F.col("tod_seconds")))
    )
