"""The reporting period chosen by a reader: a week, month, quarter or year."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAINS = ("week", "iso_week", "month", "quarter", "year")


@dataclass(frozen=True)
class Period:
    """``week`` pairs the calendar year with the ISO week number, as the original does.

    ``iso_week`` pairs the ISO year with it: seven days in a row, also at the turn of the year.
    """

    grain: str
    year: int
    month: int | None = None
    week: int | None = None

    def __post_init__(self):
        if self.grain not in GRAINS:
            raise ValueError(f"unknown grain {self.grain!r}, expected one of {GRAINS}")
        needed = {"week": "week", "iso_week": "week", "month": "month", "quarter": "month"}.get(self.grain)
        if needed and getattr(self, needed) is None:
            raise ValueError(f"grain {self.grain!r} needs a {needed}")

    def monthly(self) -> Period:
        """Money has no weekly view; a week shows its month."""
        return replace(self, grain="month") if self.grain in ("week", "iso_week") else self

    def months(self) -> tuple[int, int]:
        if self.grain == "month":
            return self.month, self.month
        if self.grain == "quarter":
            first = (self.month - 1) // 3 * 3 + 1
            return first, first + 2
        return 1, 12

    def dates(self) -> tuple[dt.date, dt.date]:
        """First day, and the day after the last, that can lie in the period.

        Weeks 2 to 51 are seven days inside their calendar year. The others may
        have days at both ends of it, so they span the year.
        """
        if self.grain == "iso_week" or (self.grain == "week" and 2 <= self.week <= 51):
            monday = dt.date.fromisocalendar(self.year, self.week, 1)
            return monday, monday + dt.timedelta(days=7)
        first, last = (1, 12) if self.grain == "week" else self.months()
        after = dt.date(self.year + last // 12, last % 12 + 1, 1)
        return dt.date(self.year, first, 1), after


def within_dates(df: DataFrame, column: str, period: Period | None) -> DataFrame:
    """Bound a date or timestamp column by a period, as a range a file scan can use."""
    if period is None:
        return df
    start, after = period.dates()
    return df.where((F.col(column) >= F.lit(start)) & (F.col(column) < F.lit(after)))


def period_filter(df: DataFrame, period: Period, date: str | None = None) -> DataFrame:
    """Keep the rows of a period by their ``year`` and ``month`` or ``week_number``.

    ``date`` names a DATE column to bound as well: where year and month are
    computed from it, the range is what reaches the file scan. An ISO week needs it.
    """
    if period.grain == "iso_week":
        if not date:
            raise ValueError("grain 'iso_week' needs a date column")
        return within_dates(df, date, period)
    keep = F.col("year") == period.year
    first, last = period.months()
    if period.grain == "week":
        keep &= F.col("week_number") == period.week
    elif first == last:
        keep &= F.col("month") == first
    elif (first, last) != (1, 12):
        keep &= F.col("month").between(first, last)
    return within_dates(df, date, period).where(keep) if date else df.where(keep)
