import datetime as dt

import pytest

from tallyspark import Period
from tallyspark.operators.periods import period_filter

from .conftest import rows


@pytest.fixture(scope="module")
def days(spark):
    start = dt.date(2022, 12, 25)
    data = []
    for i in range(500):
        day = start + dt.timedelta(days=i)
        data.append((day, day.year, day.month, day.isocalendar().week))
    return spark.createDataFrame(data, "date date, year bigint, month bigint, week_number bigint")


@pytest.mark.parametrize("date", [None, "date"])
@pytest.mark.parametrize(
    "period, keep",
    [
        (Period("week", 2023, week=52), lambda d: d.year == 2023 and d.isocalendar().week == 52),
        (Period("week", 2023, week=1), lambda d: d.year == 2023 and d.isocalendar().week == 1),
        (Period("week", 2023, week=2), lambda d: d.year == 2023 and d.isocalendar().week == 2),
        (Period("week", 2023, week=51), lambda d: d.year == 2023 and d.isocalendar().week == 51),
        (Period("month", 2023, month=12), lambda d: (d.year, d.month) == (2023, 12)),
        (Period("quarter", 2023, month=5), lambda d: d.year == 2023 and d.month in (4, 5, 6)),
        (Period("quarter", 2023, month=12), lambda d: d.year == 2023 and d.month >= 10),
        (Period("year", 2023), lambda d: d.year == 2023),
    ],
)
def test_filter_matches_brute_force(days, period, keep, date):
    expected = [(r.date,) for r in days.collect() if keep(r.date)]
    assert rows(period_filter(days, period, date), "date") == sorted(expected)


def test_iso_week_52_includes_new_years_day(days):
    found = rows(period_filter(days, Period("week", 2023, week=52)), "date")
    assert (dt.date(2023, 1, 1),) in found


def test_unknown_grain():
    with pytest.raises(ValueError, match="grain"):
        Period("decade", 2023)


def test_missing_part():
    with pytest.raises(ValueError, match="needs a month"):
        Period("quarter", 2023)


def test_week_shows_its_month():
    assert Period("week", 2023, month=3, week=10).monthly() == Period("month", 2023, 3, 10)
    with pytest.raises(ValueError):
        Period("week", 2023, week=10).monthly()


@pytest.mark.parametrize("year", range(2015, 2035))
def test_week_dates_hold_every_day_of_the_week(year):
    day = dt.date(year, 1, 1)
    while day.year == year:
        start, after = Period("week", year, week=day.isocalendar().week).dates()
        assert start <= day < after
        day += dt.timedelta(days=1)


def test_iso_weeks_run_over_the_turn_of_the_year(spark):
    days = [dt.date(1996, 12, 29) + dt.timedelta(days=i) for i in range(9)]
    df = spark.createDataFrame([(d,) for d in days], "day date")
    found = rows(period_filter(df, Period("iso_week", 1997, week=1), "day"))
    assert found == [(d,) for d in days[1:8]]
    assert Period("iso_week", 1997, month=1, week=1).monthly().grain == "month"
    with pytest.raises(ValueError):
        period_filter(df, Period("iso_week", 1997, week=1))
