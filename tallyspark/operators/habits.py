"""Habit history and its weekly sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import date_parts, exact_avg, exact_sum, iso_week, millis_to_date
from tallyspark.schemas import MEASURE

KEYS = ("user",)


def habit_history(habits: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows of the flat ``[ms, count, ms, count, ...]`` history of each habit document.

    A trailing odd entry is ignored; of a repeated time the last count stays.
    Sorting the pairs inside the row keeps this free of a shuffle.
    """
    pairs = F.floor(F.size("history") / 2).cast("int")
    entry = F.transform(
        F.sequence(F.lit(0), pairs - 1),
        lambda i: F.struct(
            F.get("history", i * 2).cast("bigint").alias("time_ms"),
            i.alias("pos"),
            F.get("history", i * 2 + 1).alias("count"),
        ),
    )
    entries = habits.withColumn(
        "entries", F.sort_array(F.when(pairs > 0, entry))
    ).select(
        *keys,
        "id",
        F.col("title").alias("name"),
        F.col("isPositive").alias("positive"),
        "target",
        "period",
        # Each entry beside the one after it; the zip leaves NULL beside the last.
        F.inline(
            F.arrays_zip(
                F.col("entries").alias("entry"),
                F.slice("entries", F.lit(2), F.size("entries")).alias("following"),
            )
        ),
    )
    last_of_time = ~F.col("entry.time_ms").eqNullSafe(F.col("following.time_ms"))
    day = millis_to_date(F.col("entry.time_ms"))
    return entries.where(last_of_time).select(
        *keys,
        day.alias("timestamp"),
        "entry.time_ms",
        "entry.count",
        "id",
        "name",
        "positive",
        "target",
        "period",
        iso_week(day).alias("week_number"),
    )


def habit_week(history: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Weekly habits: summed count and mean target per habit and week."""
    group = [*keys, "name", "positive", "week_number", "year", "month"]
    return (
        history.where(F.col("period") == "week")
        .select("*", *date_parts("timestamp", "year", "month"))
        .dropna(subset=group)
        .groupBy(*group)
        .agg(exact_sum("count", MEASURE).alias("value"), exact_avg("target", MEASURE).alias("target"))
    )
