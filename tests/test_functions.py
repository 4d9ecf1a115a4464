import datetime as dt
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyspark import functions as X
from tallyspark.schemas import MEASURE


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column).first()[0]


def column(spark, values, kind):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def test_not_in_keeps_null(spark):
    df = column(spark, ["bonus", "rent", None], "string")
    assert {r.x for r in df.where(X.not_in("x", ["bonus"])).collect()} == {"rent", None}


def test_sum_of_nothing_is_zero_and_mean_is_null(spark):
    df = column(spark, [None], "double")
    total, mean = df.agg(X.exact_sum("x"), X.exact_avg("x")).first()
    assert (total, mean) == (0.0, None)


def test_sums_ignore_nan_as_missing(spark):
    df = column(spark, [1.25, math.nan, None, 2.5], "double")
    assert tuple(df.agg(X.exact_sum("x"), X.exact_avg("x")).first()) == (3.75, 1.875)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(-(10**9), 10**9), min_size=1, max_size=30))
def test_sum_does_not_depend_on_partitioning(spark, cents):
    df = column(spark, [c / 100 for c in cents], "double")
    spread = df.repartition(7).agg(X.exact_sum("x")).first()[0]
    assert spread == df.coalesce(1).agg(X.exact_sum("x")).first()[0] == sum(cents) / 100


@pytest.mark.parametrize(
    "value, places, expected",
    [(125.0, -1, 120.0), (135.0, -1, 140.0), (-125.0, -1, -120.0), (0.125, 2, 0.12), (2.375, 2, 2.38)],
)
def test_half_even(spark, value, places, expected):
    assert one(spark, X.half_even(F.col("x"), places), x=value) == expected


def test_distinct_small_counts_exactly(spark):
    df = column(spark, [1, 53, 53, 1, 0, 63, None], "int")
    assert df.agg(X.distinct_small("x")).first()[0] == 4
    assert df.where("x > 100").agg(X.distinct_small("x")).first()[0] == 0


@pytest.mark.parametrize("value, text", [(-1230.0, "$-1,230"), (0.0, "$0"), (1234567.0, "$1,234,567")])
def test_money_text(spark, value, text):
    assert one(spark, X.money_text(F.col("x")), x=value) == text


def test_iso_week_pairs_with_calendar_year(spark):
    day = dt.date(2023, 1, 1)
    assert one(spark, X.iso_week("x"), x=day) == 52
    assert one(spark, X.date_parts("x", "year")[0], x=day) == 2023


def test_days_in_month(spark):
    assert one(spark, X.days_in_month(F.col("x")), x=dt.date(2024, 2, 3)) == 29


def clock(text):
    hour, minute = text.split(":")
    return int(hour) * 3600 + int(minute) * 60


@pytest.mark.parametrize(
    "times, mean",
    [
        (["23:00", "01:30"], "00:15"),
        (["22:00", "23:00"], "22:30"),
        (["23:50", "00:04"], "23:57"),
        (["06:00"], "06:00"),
        (["00:00"], "00:00"),
    ],
)
def test_circular_mean(spark, times, mean):
    df = column(spark, [clock(t) for t in times], "int")
    seconds = df.agg(X.circular_mean_seconds(F.col("x"))).first()[0]
    assert seconds == clock(mean)


def test_circular_mean_cuts_fractions_towards_midnight(spark):
    late = column(spark, [86400 - 101, 86400 - 100], "int")
    assert late.agg(X.circular_mean_seconds(F.col("x"))).first()[0] == 86400 - 100
    early = column(spark, [100, 101], "int")
    assert early.agg(X.circular_mean_seconds(F.col("x"))).first()[0] == 100


def test_circular_mean_of_nothing(spark):
    assert column(spark, [None], "int").agg(X.circular_mean_seconds(F.col("x"))).first()[0] is None


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 86399))
def test_clock_text_matches_strftime(spark, seconds):
    moment = dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)
    df = spark.range(1).select(F.lit(seconds).alias("x"))
    shown = df.select(
        X.clock_text(F.col("x")),
        X.clock_text(F.col("x"), twelve_hour=True, suffix=True),
        X.clock_text(F.col("x"), twelve_hour=True),
    ).first()
    assert tuple(shown) == tuple(moment.strftime(p) for p in ("%H:%M", "%I:%M %p", "%I:%M"))


def test_clock_text_of_null(spark):
    assert one(spark, X.clock_text(F.lit(None).cast("int"), True, True)) is None


def test_as_date_reads_text_dates_and_timestamps(spark):
    df = column(spark, ["2024-03-01", "unassigned", None], "string")
    assert [r[0] for r in df.select(X.as_date(df, "x")).collect()] == [dt.date(2024, 3, 1), None, None]
    df = column(spark, [dt.datetime(2024, 3, 1, 23, 59)], "timestamp_ntz")
    assert df.select(X.as_date(df, "x")).first()[0] == dt.date(2024, 3, 1)


def test_tracked_sums_do_not_overflow(spark):
    """5 * 10**12 a million times over: beyond a long of millionths."""
    df = spark.range(4).select(F.lit(5e12).alias("x"))
    total, mean = df.agg(X.exact_sum("x", MEASURE), X.exact_avg("x", MEASURE)).first()
    assert (total, mean) == (2e13, 5e12)


def test_tracked_sums_of_mixed_signs(spark):
    df = column(spark, [1.25, -2.5, 0.000001, -0.75], "double")
    assert df.agg(X.exact_sum("x", MEASURE)).first()[0] == -1.999999


def test_sums_keep_every_digit(spark):
    small = spark.range(1000).select(F.lit(0.004).alias("x"))
    assert small.agg(X.exact_sum("x")).first()[0] == 4.0


def test_values_beyond_the_decimal_stay_visible(spark):
    df = column(spark, [1e17, 0.25, float("nan"), None], "double")
    assert df.agg(X.exact_sum("x"), X.exact_avg("x")).first() == (1e17, 5e16)
    odd = column(spark, [1.0, float("inf"), 1e30], "double")
    assert odd.agg(X.exact_sum("x"), X.exact_avg("x")).first() == (float("inf"), float("inf"))
