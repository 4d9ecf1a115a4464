"""Tracked attributes against their targets, and the mood rating."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import as_date, date_parts, days_in_month, exact_avg, iso_week, shared_keys
from tallyspark.operators.periods import Period, within_dates
from tallyspark.schemas import MEASURE

KEYS = ("user",)

# Canonical names of two attributes, and those where less is better.
RECODED = {"bedtime": "sleep_start", "wake_time": "sleep_end"}
LESS_IS_BETTER = ("sleep_start", "sleep_end")


def format_attributes(
    attributes: DataFrame, targets: DataFrame, as_of: dt.date, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Attributes that have a target, in comparable units, without the running day.

    A missing value counts as 0. Bedtimes arrive as minutes after noon, wake
    times as minutes after midnight; both leave as hours.
    """
    name = F.lower(F.replace(F.col("attribute"), F.lit(" "), F.lit("_")))
    for old, new in RECODED.items():
        name = F.when(name == old, F.lit(new)).otherwise(name)
    on = [*shared_keys(targets, keys), "attribute"]
    number = F.when(F.col("raw").isNull(), F.lit(0.0)).otherwise(
        F.nanvl(F.col("raw").try_cast("double"), F.lit(0.0))
    )
    value = (
        F.when(F.col("attribute") == "sleep_start", (F.col("value") / 60 + 12) % 24)
        .when(F.col("attribute") == "sleep_end", F.col("value") / 60)
        .otherwise(F.col("value"))
    )
    achieved = F.when(
        F.col("attribute").isin(*LESS_IS_BETTER), F.col("value") <= F.col("target")
    ).otherwise(F.col("value") >= F.col("target"))
    return (
        attributes.select(
            *keys,
            as_date(attributes, "date").alias("date"),
            name.alias("attribute"),
            F.col("value").alias("raw"),
        )
        .where(F.col("date").isNull() | (F.col("date") != F.lit(as_of)))
        .join(targets.select(*on, F.col("target").cast("double").alias("target")), on)
        .withColumn("value", number)
        .withColumn("value", value)
        .select(
            *keys,
            "date",
            "attribute",
            "value",
            "target",
            *date_parts("date", "year", "month"),
            F.coalesce(achieved, F.lit(False)).alias("achieved"),
        )
    )


def weekly_rating(formatted: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean mood and target per ISO week, under the name ``Rating``."""
    group = [*keys, "year", "month", "week_number"]
    return (
        formatted.where(F.col("attribute") == "mood")
        .withColumn("week_number", iso_week("date"))
        .dropna(subset=group)
        .groupBy(*group)
        .agg(exact_avg("value", MEASURE).alias("value"), exact_avg("target", MEASURE).alias("target"))
        .withColumn("name", F.lit("Rating"))
        .withColumn("positive", F.lit(True))
    )


def habit_achievement(
    formatted: DataFrame, year: int, month: int, as_of: dt.date, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Days an attribute met its target in a month, next to the days there were."""
    first = dt.date(year, month, 1)
    if (as_of.year, as_of.month) == (year, month):
        days = F.lit(as_of.day - 1).cast("bigint")
    else:
        days = days_in_month(F.lit(first))
    return (
        within_dates(formatted, "date", Period("month", year, month))
        .dropna(subset=list(keys))
        .groupBy(*keys, "attribute")
        .agg(F.sum(F.col("achieved").cast("bigint")).alias("achieved"))
        .withColumn("month_days", days)
    )
