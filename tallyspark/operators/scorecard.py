"""Habits, mood and sleep of a period on one card.

Habits and mood carry a number in ``value``, sleep a time in ``tod_seconds``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import (
    clock_text,
    distinct_small,
    exact_avg,
    exact_sum,
    half_even,
    not_in,
)
from tallyspark.functions.expressions import small_mask
from tallyspark.schemas import MEASURE
from tallyspark.operators.periods import Period, period_filter
from tallyspark.operators.sleep import SLEEP_NAMES, mean_of_day

KEYS = ("user",)
RATING = "Rating"


def scored(
    habits: DataFrame, rating: DataFrame, sleep: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Union of the weekly habits, weekly ratings and nightly sleep rows."""
    numbers = habits.unionByName(rating)
    rows = numbers.unionByName(sleep, allowMissingColumns=True)
    return rows.select(
        *keys,
        "name",
        "positive",
        "year",
        "month",
        "week_number",
        "value",
        "target",
        "tod_seconds",
        "target_seconds",
    )


def distinct_weeks(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Weeks present in a selection, whatever the row kind."""
    return rows.groupBy(*keys).agg(distinct_small("week_number").alias("week_count"))


def scorecard_base(rows: DataFrame, period: Period, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per habit, rating and sleep kind for the period.

    A weekly habit target is scaled by the weeks of the user's whole selection.
    Each group carries its weeks as a bit mask, so the user-wide count is a window
    over one row per name rather than a second pass over the scored rows.
    """
    user = Window.partitionBy(*keys)
    weeks = F.bit_count(F.bit_or("weeks").over(user))
    groups = (
        period_filter(rows, period)
        .dropna(subset=[*keys, "name", "positive"])
        .groupBy(*keys, "name", "positive", "target_seconds")
        .agg(
            exact_sum("value", MEASURE).alias("sum_value"),
            exact_avg("value", MEASURE).alias("mean_value"),
            exact_avg("target", MEASURE).alias("mean_target"),
            mean_of_day(F.col("name"), F.col("tod_seconds")).alias("mean_tod"),
            F.bit_or(small_mask("week_number")).alias("weeks"),
        )
        .withColumn("week_count", weeks)
    )
    is_sleep = F.col("name").isin(*SLEEP_NAMES)
    is_rating = F.col("name") == RATING
    return groups.select(
        *keys,
        "name",
        "positive",
        F.when(is_sleep, "sleep").when(is_rating, "rating").otherwise("habit").alias("kind"),
        F.when(is_rating, half_even(F.col("mean_value"), 2))
        .when(~is_sleep, F.col("sum_value"))
        .alias("value"),
        F.when(is_rating, F.col("mean_target"))
        .when(~is_sleep, F.col("mean_target") * F.col("week_count"))
        .alias("target"),
        F.when(is_sleep, F.col("mean_tod")).alias("tod_seconds"),
        "target_seconds",
    )


def _judged(base: DataFrame) -> DataFrame:
    return base.where(not_in("name", SLEEP_NAMES))


def scorecard_success(base: DataFrame) -> DataFrame:
    """Positive habits at or above target, negative ones at or below."""
    met = (F.col("positive") & (F.col("value") >= F.col("target"))) | (
        ~F.col("positive") & (F.col("value") <= F.col("target"))
    )
    return _judged(base).where(met)


def scorecard_fail(base: DataFrame) -> DataFrame:
    """The strict opposite; rows without a value or target are in neither."""
    missed = (F.col("positive") & (F.col("value") < F.col("target"))) | (
        ~F.col("positive") & (F.col("value") > F.col("target"))
    )
    return _judged(base).where(missed)


def supporting_table(base: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Sleep averages as clock text, in the order Wake, Bed, Duration.

    Durations use the same twelve-hour form without AM/PM, so half an hour
    reads 12:30; ``tod_seconds`` has the number.
    """
    rank = F.when(F.col("name") == "Wake", 1).when(F.col("name") == "Bed", 2).otherwise(3)
    seconds = F.col("tod_seconds")
    text = F.when(
        F.col("name") == "Duration", clock_text(seconds, twelve_hour=True)
    ).otherwise(clock_text(seconds, twelve_hour=True, suffix=True))
    return (
        base.where(F.col("kind") == "sleep")
        .select(*keys, "name", text.alias("value"), "tod_seconds", rank.alias("position"))
        .orderBy(*keys, "position")
        .drop("position")
    )
