"""The catalogue's composite tables, from canonical inputs to what a dashboard shows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame

from tallyspark.operators.attributes import format_attributes, weekly_rating
from tallyspark.operators.habits import habit_history, habit_week
from tallyspark.operators.periods import Period, within_dates
from tallyspark.operators.scorecard import scored
from tallyspark.operators.sleep import format_sleep, sleep_nights
from tallyspark.operators.tasks import category_paths, tasks

KEYS = ("user",)


def scored_table(
    history: DataFrame,
    attributes: DataFrame,
    targets: DataFrame,
    nights: DataFrame,
    as_of: dt.date,
    keys: Sequence[str] = KEYS,
    period: Period | None = None,
) -> DataFrame:
    """Scorecard input from the habit, attribute and sleep snapshots.

    ``period`` bounds each source by date ahead of its aggregation. It changes
    nothing for a card of that period and spares reading the other days.
    """
    formatted = format_attributes(attributes, targets, as_of, keys)
    return scored(
        habit_week(within_dates(history, "timestamp", period), keys),
        weekly_rating(within_dates(formatted, "date", period), keys),
        format_sleep(within_dates(nights, "wakeup", period), keys),
        keys,
    )


def scored_from_raw(
    habit_docs: DataFrame,
    attributes: DataFrame,
    targets: DataFrame,
    sleep_records: DataFrame,
    as_of: dt.date,
    keys: Sequence[str] = KEYS,
    period: Period | None = None,
) -> DataFrame:
    """Scorecard input straight from the landed records.

    All fragments of a night end on the date of waking, so bounding the
    fragments' ends keeps nights whole.
    """
    return scored_table(
        habit_history(habit_docs, keys),
        attributes,
        targets,
        sleep_nights(within_dates(sleep_records, "end_wall", period), keys),
        as_of,
        keys,
        period,
    )


def tasks_from_docs(
    task_docs: DataFrame, categories: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    return tasks(task_docs, category_paths(categories, keys), keys)
