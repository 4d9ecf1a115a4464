"""Column helpers shared by the operators. All are built-in expressions, no Python UDFs."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import WindowSpec

from tallyspark.schemas import MONEY


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def shared_keys(dimension: DataFrame, keys: Sequence[str]) -> list[str]:
    """The grouping keys a dimension carries; one without ``user`` applies to everybody."""
    return [k for k in keys if k in dimension.columns]


def not_in(column: Column | str, values: Iterable) -> Column:
    """``NOT IN`` that keeps NULL rows."""
    return ~F.coalesce(_col(column).isin(list(values)), F.lit(False))


def as_date(df: DataFrame, column: str) -> Column:
    """A DATE from a date, timestamp or ISO text column; unreadable text is NULL."""
    if isinstance(df.schema[column].dataType, StringType):
        return F.col(column).try_cast("date")
    return F.col(column).cast("date")


def date_parts(column: Column | str, *parts: str) -> list[Column]:
    pick = {"year": F.year, "month": F.month, "day": F.dayofmonth}
    return [pick[p](_col(column)).cast("bigint").alias(p) for p in parts]


def iso_week(column: Column | str) -> Column:
    return F.weekofyear(_col(column)).cast("bigint")


def month_start(year: Column | str = "year", month: Column | str = "month") -> Column:
    return F.make_date(_col(year).cast("int"), _col(month).cast("int"), F.lit(1))


def days_in_month(column: Column) -> Column:
    return F.dayofmonth(F.last_day(column)).cast("bigint")


def millis_to_date(column: Column) -> Column:
    """Local date (session zone) of an epoch-millisecond number."""
    return F.to_date(F.timestamp_millis(column.cast("bigint")))


def exact(column: Column | str, kind: str = MONEY) -> Column:
    """The value as an exact decimal; NULL where none can hold it."""
    return _col(column).try_cast(kind)


def beyond(column: Column | str, kind: str = MONEY) -> Column:
    """Infinite values and those too large for the decimal, else NULL. NaN counts as missing."""
    x = _col(column).try_cast("double")
    return F.when(exact(column, kind).isNull() & ~F.isnan(x), x)


def _total(column: Column | str, kind: str, over: WindowSpec | None = None) -> Column:
    """Decimal total plus what no decimal holds, which stays visible in the result."""

    def total(x: Column) -> Column:
        return F.sum(x) if over is None else F.sum(x).over(over)

    held, rest = total(exact(column, kind)).cast("double"), total(beyond(column, kind))
    return F.when(rest.isNull(), held).otherwise(F.coalesce(held, F.lit(0.0)) + rest)


def exact_sum(column: Column | str, kind: str = MONEY) -> Column:
    """Sum of exact decimals, so the result keeps every digit and does not depend on partitioning.

    The sum of no rows is 0. An infinite amount makes its group's sum infinite and never ends
    the job.
    """
    return F.coalesce(_total(column, kind), F.lit(0.0))


def exact_avg(
    column: Column | str, kind: str = MONEY, over: WindowSpec | None = None
) -> Column:
    """Mean of exact decimals, of a group or ``over`` a window; the mean of no rows is NULL."""
    rows = F.count(F.coalesce(exact(column, kind).cast("double"), beyond(column, kind)))
    if over is not None:
        rows = rows.over(over)
    return F.try_divide(_total(column, kind, over), rows.cast("double"))


def half_even(column: Column, places: int) -> Column:
    """Round to a number of places (negative: tens, hundreds), ties to the even digit."""
    if places >= 0:
        return F.rint(column * F.lit(float(10**places))) / F.lit(float(10**places))
    return F.rint(column / F.lit(float(10**-places))) * F.lit(float(10**-places))


def small_mask(column: Column | str) -> Column:
    """One bit per value 0..63 (month and week numbers)."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), _col(column).cast("int"))


def distinct_small(column: Column | str) -> Column:
    """Exact distinct count of values 0..63.

    A bit mask merges map-side in eight bytes, where ``count(distinct)`` would
    add a second shuffle keyed by the value.
    """
    mask = F.coalesce(F.bit_or(small_mask(column)), F.lit(0).cast("bigint"))
    return F.bit_count(mask).cast("bigint")


def money_text(column: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(column, 0))
