import datetime as dt

import pytest

from tallyspark.operators import attributes

from .conftest import rows

TODAY = dt.date(2024, 2, 10)


@pytest.fixture(scope="module")
def targets(spark):
    data = [("mood", 5.0), ("sleep_start", 23.0), ("sleep_end", 7.0), ("steps_taken", 100.0)]
    return spark.createDataFrame(data, "attribute string, target double")


@pytest.fixture(scope="module")
def formatted(spark, targets):
    data = [
        ("a", "2024-01-31", "7", "Mood"),
        ("a", "2024-02-01", None, "Mood"),
        ("a", "2024-02-01", "660", "Bedtime"),
        ("a", "2024-02-02", "720", "Bedtime"),
        ("a", "2024-02-01", "420", "Wake time"),
        ("a", "2024-02-01", "430", "Wake time"),
        ("a", "2024-02-01", "100", "Steps taken"),
        ("a", "2024-02-01", "NaN", "Steps taken"),
        ("a", "2024-02-01", "9", "Untracked"),
        ("a", "2024-02-10", "9", "Mood"),
        ("b", "2024-02-03", "3", "Mood"),
    ]
    df = spark.createDataFrame(data, "user string, date string, value string, attribute string")
    return attributes.format_attributes(df, targets, TODAY)


def test_format(formatted):
    found = rows(formatted.where("user = 'a'"), "attribute", "date", "value", "achieved")
    first, second = dt.date(2024, 2, 1), dt.date(2024, 2, 2)
    assert found == sorted(
        [
            ("mood", dt.date(2024, 1, 31), 7.0, True),
            ("mood", first, 0.0, False),
            ("sleep_start", first, 23.0, True),
            ("sleep_start", second, 0.0, True),
            ("sleep_end", first, 7.0, True),
            ("sleep_end", first, 430 / 60, False),
            ("steps_taken", first, 100.0, True),
            ("steps_taken", first, 0.0, False),
        ]
    )


def test_targets_per_user(spark):
    values = spark.createDataFrame(
        [("a", "2024-02-01", "5", "Mood"), ("b", "2024-02-01", "5", "Mood")],
        "user string, date string, value string, attribute string",
    )
    own = spark.createDataFrame([("a", "mood", 4.0), ("b", "mood", 6.0)], "user string, attribute string, target double")
    found = attributes.format_attributes(values, own, TODAY)
    assert rows(found, "user", "achieved") == [("a", True), ("b", False)]


def test_weekly_rating(formatted):
    found = attributes.weekly_rating(formatted)
    assert rows(found, "user", "year", "month", "week_number", "value", "target", "name", "positive") == [
        ("a", 2024, 1, 5, 7.0, 5.0, "Rating", True),
        ("a", 2024, 2, 5, 0.0, 5.0, "Rating", True),
        ("b", 2024, 2, 5, 3.0, 5.0, "Rating", True),
    ]


@pytest.mark.parametrize("as_of, days", [(TODAY, 9), (dt.date(2024, 3, 1), 29)])
def test_habit_achievement(formatted, as_of, days):
    found = attributes.habit_achievement(formatted.where("user = 'a'"), 2024, 2, as_of)
    assert rows(found, "attribute", "achieved", "month_days") == [
        ("mood", 0, days),
        ("sleep_end", 1, days),
        ("sleep_start", 2, days),
        ("steps_taken", 1, days),
    ]
