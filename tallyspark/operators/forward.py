"""Forward budget: what a usual and a lean month look like per user."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import exact_avg, exact_sum, half_even, not_in
from tallyspark.operators.spending import EARNED, _from_year

KEYS = ("user",)


def _lower_quartile(column: Column) -> Column:
    # Linear interpolation between cents lands on quarter cents.
    return half_even(F.percentile(column, 0.25), 4)


def forward_stats(monthly: DataFrame, name: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean and 25th percentile of ``total`` as rows ``mean`` and ``25%``.

    The exact percentile keeps a group's distinct values; monthly totals bound
    them by the number of months.
    """
    stats = monthly.groupBy(*keys).agg(
        exact_avg("total").alias("mean"), _lower_quartile(F.col("total")).alias("25%")
    )
    return stats.unpivot(list(keys), ["mean", "25%"], "variable", name)


def forward_budget(
    finance: DataFrame,
    start_year: int = 2021,
    income: Sequence[str] = ("paycheck",),
    earned: Sequence[str] = EARNED,
    irregular: Sequence[str] = ("bonus",),
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Mean and lower quartile of monthly spending, income and profit.

    All three series come from one pass over the daily rows. A user missing one
    of them drops out, as in a natural join of the three.
    """

    def month_total(keep: Column, name: str) -> Column:
        total = exact_sum(F.when(keep, F.col("total")))
        return F.when(F.count(F.when(keep, 1)) > 0, total).alias(name)

    series = ("spending", "income", "profit")
    months = (
        _from_year(finance, start_year)
        .dropna(subset=[*keys, "category"])
        .groupBy(*keys, "year", "month")
        .agg(
            month_total(not_in("category", earned), "spending"),
            month_total(F.col("category").isin(*income), "income"),
            month_total(not_in("category", irregular), "profit"),
        )
    )
    stats = months.groupBy(*keys).agg(
        *[exact_avg(s).alias(f"mean_{s}") for s in series],
        *[_lower_quartile(F.col(s)).alias(f"low_{s}") for s in series],
    ).dropna(subset=[f"mean_{s}" for s in series])
    rows = F.array(
        F.struct(F.lit("mean").alias("variable"), *[F.col(f"mean_{s}").alias(s) for s in series]),
        F.struct(F.lit("25%").alias("variable"), *[F.col(f"low_{s}").alias(s) for s in series]),
    )
    return stats.select(*keys, F.inline(rows))
