import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.operators import habits

from .conftest import rows

SCHEMA = (
    "user string, id string, title string, isPositive boolean, target double, period string, "
    "history array<double>"
)
DAY_MS = 86_400_000


def docs(spark, *histories, period="week", target=3.0):
    data = [("a", f"h{i}", f"habit{i}", True, target, period, h) for i, h in enumerate(histories)]
    return spark.createDataFrame(data, SCHEMA)


def test_odd_tail_is_ignored(spark):
    found = habits.habit_history(docs(spark, [1.0, 2.0, 3.0, 4.0, 5.0]))
    assert rows(found, "time_ms", "count") == [(1, 2.0), (3, 4.0)]


def test_empty_missing_and_single_histories_vanish(spark):
    assert habits.habit_history(docs(spark, [], None, [7.0])).count() == 0


def test_dates_and_weeks(spark):
    new_year = 1672531200000.0  # 2023-01-01
    found = habits.habit_history(docs(spark, [new_year, 1.0])).first()
    assert (found.timestamp, found.week_number) == (dt.date(2023, 1, 1), 52)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=12), min_size=1, max_size=4))
def test_history_matches_a_dict(spark, histories):
    histories = [[float(x) for x in h] for h in histories]
    found = habits.habit_history(docs(spark, *histories))
    expected = [
        (f"h{i}", int(time), count)
        for i, h in enumerate(histories)
        for time, count in dict(zip(h[::2], h[1::2])).items()
    ]
    assert rows(found, "id", "time_ms", "count") == sorted(expected)


def test_habit_week(spark):
    monday = 1704672000000.0  # 2024-01-08
    history = [monday, 1.5, monday + DAY_MS, 2.0, monday + 7 * DAY_MS, 4.0]
    weekly = habits.habit_week(habits.habit_history(docs(spark, history)))
    assert rows(weekly, "week_number", "year", "month", "value", "target") == [
        (2, 2024, 1, 3.5, 3.0),
        (3, 2024, 1, 4.0, 3.0),
    ]


def test_only_weekly_habits(spark):
    found = habits.habit_history(docs(spark, [1.0, 1.0], period="day"))
    assert habits.habit_week(found).count() == 0


def test_missing_target_stays_missing(spark):
    weekly = habits.habit_week(habits.habit_history(docs(spark, [1.0, 1.0], target=None)))
    assert rows(weekly, "value", "target") == [(1.0, None)]
