import datetime as dt

import pytest

from tallyspark.operators import sleep
from tallyspark.sources.landed import sleep_times

from .conftest import rows


def records(spark, *spans, user="a"):
    data = [(user, start, end) for start, end in spans]
    raw = spark.createDataFrame(data, "user string, start string, end string")
    return raw.select("user", *sleep_times("start", "end"))


def test_fragments_of_a_date_make_one_night(spark):
    nights = sleep.sleep_nights(
        records(
            spark,
            ("2024-01-01 23:10:00 +0100", "2024-01-02 02:00:00 +0100"),
            ("2024-01-02 02:05:00 +0100", "2024-01-02 06:59:30 +0100"),
            ("2024-01-02 23:30:00 +0100", "2024-01-03 07:00:00 +0100"),
        )
    )
    assert rows(nights, "bedtime", "wakeup", "duration_seconds", "week") == [
        (dt.datetime(2024, 1, 1, 23, 10), dt.datetime(2024, 1, 2, 6, 59, 30), 28170, 1),
        (dt.datetime(2024, 1, 2, 23, 30), dt.datetime(2024, 1, 3, 7, 0), 27000, 1),
    ]


@pytest.mark.parametrize("hour, kept", [(22, 0), (23, 0), (0, 0), (3, 0), (4, 1), (12, 1), (21, 1)])
def test_plausible_wakeups(spark, hour, kept):
    end = f"2024-01-02 {hour:02d}:30:00 +0000"
    assert sleep.sleep_nights(records(spark, ("2024-01-02 00:00:00 +0000", end))).count() == kept


def test_offset_change_keeps_wall_clock_and_true_duration(spark):
    nights = sleep.sleep_nights(
        records(spark, ("2024-03-31 00:00:00 +0100", "2024-03-31 08:00:00 +0200"))
    )
    night = nights.first()
    assert (night.wakeup, night.duration_seconds) == (dt.datetime(2024, 3, 31, 8, 0), 7 * 3600)


def test_format_floors_to_minutes_and_wraps_long_nights(spark):
    nights = sleep.sleep_nights(
        records(spark, ("2024-01-01 06:00:59 +0000", "2024-01-02 07:30:58 +0000"))
    )
    found = {r.name: r for r in sleep.format_sleep(nights).collect()}
    assert {n: r.tod_seconds for n, r in found.items()} == {
        "Wake": 7 * 3600 + 1800,
        "Bed": 6 * 3600,
        "Duration": 3600 + 29 * 60,
    }
    targets = {"Wake": 6 * 3600, "Bed": 22 * 3600, "Duration": 8 * 3600 + 1800}
    assert {n: r.target_seconds for n, r in found.items()} == targets
    assert {n: r.positive for n, r in found.items()} == {"Wake": False, "Bed": False, "Duration": True}


@pytest.fixture(scope="module")
def formatted(spark):
    return sleep.format_sleep(
        sleep.sleep_nights(
            records(
                spark,
                ("2024-01-01 23:00:00 +0000", "2024-01-02 07:00:00 +0000"),
                ("2024-01-03 01:30:00 +0000", "2024-01-03 08:00:00 +0000"),
            )
        )
    )


def test_averages(formatted):
    assert rows(sleep.avg_sleep(formatted), "name", "value") == [
        ("Bed", "00:15"),
        ("Duration", "07:15"),
        ("Wake", "07:30"),
    ]
    assert rows(sleep.avg_time_of_day(formatted), "name", "value") == [("Bed", "00:15"), ("Wake", "07:30")]
    assert rows(sleep.avg_duration(formatted), "value") == [("07:15",)]


def test_no_rows_give_no_average(formatted):
    assert sleep.avg_sleep(formatted.where("year = 1990")).count() == 0
