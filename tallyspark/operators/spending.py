"""Spending, budget and account indicators over the daily, budget and account tables.

Category labels differ between households, so every label list is a parameter.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tallyspark.functions import (
    distinct_small,
    exact_avg,
    exact_sum,
    half_even,
    money_text,
    month_start,
    not_in,
    shared_keys,
)
from tallyspark.operators.joins import glue
from tallyspark.operators.periods import Period, period_filter

KEYS = ("user",)

# Default category labels of the catalogue's queries.
IRREGULAR = ("bonus", "investment")
NOT_SPENDING = ("income", "bonus")
NOT_BUDGETED = ("paycheck", "investments", "bonus")
EARNED = ("paycheck", "bonus")
NOT_IN_MIX = ("bonus", "loans", "music")
EVERYDAY = ("discretionary", "groceries")


def _date_column(finance: DataFrame) -> str | None:
    return "timestamp" if "timestamp" in finance.columns else None


def _from_month(finance: DataFrame, first: dt.date) -> DataFrame:
    """Rows from a month on; a date column is bounded as well, which a file scan can use."""
    later = F.col("year") > first.year
    keep = later | ((F.col("year") == first.year) & (F.col("month") >= first.month))
    if _date_column(finance):
        keep &= F.col("timestamp") >= F.lit(first)
    return finance.where(keep)


def _from_year(finance: DataFrame, start_year: int) -> DataFrame:
    return _from_month(finance, dt.date(start_year, 1, 1))


def _is_month(day: dt.date) -> Column:
    return (F.col("year") == day.year) & (F.col("month") == day.month)


def category_months(finance: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Total per month and category."""
    return (
        finance.dropna(subset=[*keys, "category"])
        .groupBy(*keys, "year", "month", "category")
        .agg(exact_sum("total").alias("total"))
    )


def month_sum(
    finance: DataFrame, exclude: Sequence[str] = IRREGULAR, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Net total per month without the irregular categories."""
    return (
        finance.where(not_in("category", exclude))
        .dropna(subset=list(keys))
        .groupBy(*keys, "year", "month")
        .agg(exact_sum("total").alias("total"))
        .select(
            *keys,
            "year",
            "month",
            "total",
            F.lit(1).cast("bigint").alias("day"),
            month_start().alias("datetime"),
        )
    )


def spend_vs_budget(
    finance: DataFrame,
    budget: DataFrame,
    period: Period,
    min_abs: float = 100,
    exclude: Sequence[str] = NOT_BUDGETED,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Spending and budget per category over the period, where spending matters.

    A category brings its budget once for each month it has spending in. The
    months are counted in the same aggregation that sums the spending, so the
    daily rows shuffle once and the budget joins already reduced rows.
    """
    period = period.monthly()
    spent = (
        period_filter(finance, period, _date_column(finance))
        .dropna(subset=[*keys, "category"])
        .groupBy(*keys, "category")
        .agg(exact_sum("total").alias("total"), distinct_small("month").alias("months"))
    )
    on = [*shared_keys(budget, keys), "category"]
    budgeted = half_even(F.coalesce(F.col("budget"), F.lit(0.0)) * F.col("months"), 2)
    return (
        spent.join(budget.select(*on, "budget"), on, "left")
        .select(*keys, "category", "total", budgeted.alias("budget"))
        .where((F.abs("total") > min_abs) & not_in("category", exclude))
    )


def budget_variance(spent: DataFrame) -> DataFrame:
    """Distance from budget and on which side of it."""
    gap = -(F.col("total") - F.col("budget"))
    diff = F.when(F.abs(gap) == float("inf"), 0.0).otherwise(gap)
    side = F.when(F.col("diff") < 0, "Under-Budget").otherwise("Over-Budget")
    return spent.withColumn("diff", diff).withColumn("positive", side)


def spend_budget_long(spent: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Spending and budget as two rows per category."""
    return spent.unpivot([*keys, "category"], ["total", "budget"], "variable", "value")


def monthly_income(
    finance: DataFrame,
    year: int,
    month: int,
    income: Sequence[str] = ("income",),
    keys: Sequence[str] = KEYS,
    users: DataFrame | None = None,
) -> DataFrame:
    """Income of one month; 0 for a user without any.

    ``users`` (the keys of everybody) lets the scan read that month alone. Without it, users
    come from the whole ledger.
    """
    earned = F.when(
        _is_month(dt.date(year, month, 1)) & F.col("category").isin(*income), F.col("total")
    )
    if users is not None and keys:
        finance = period_filter(finance, Period("month", year, month), _date_column(finance))
    found = finance.dropna(subset=list(keys)).groupBy(*keys).agg(exact_sum(earned).alias("income"))
    if users is None or not keys:
        return found
    everybody = users.select(*keys).dropna().distinct()
    return everybody.join(found, list(keys), "left").fillna(0.0, ["income"])


def _month_flows(
    finance: DataFrame,
    income: Sequence[str],
    not_spending: Sequence[str],
    irregular: Sequence[str],
    keys: Sequence[str],
) -> DataFrame:
    """Net, spending and income per month in one pass; NULL where a month has no such row."""

    def part(keep: Column, name: str) -> Column:
        rows = F.when(keep, F.col("total"))
        return F.when(F.count(F.when(keep, 1)) > 0, exact_sum(rows)).alias(name)

    return (
        finance.dropna(subset=list(keys))
        .groupBy(*keys, "year", "month")
        .agg(
            part(not_in("category", irregular), "net"),
            part(not_in("category", not_spending), "spend"),
            part(F.col("category").isin(*income), "income"),
        )
        .withColumn("datetime", month_start())
    )


def _income_before(last: str, user: WindowSpec) -> Column:
    """Income of the month before a user's last one, the last that is complete."""
    then = F.col("datetime") == F.add_months(last, -1)
    return F.coalesce(F.max(F.when(then, F.col("income"))).over(user), F.lit(0.0))


def budget_shortfall(
    finance: DataFrame,
    profit_target: float,
    year: int,
    month: int,
    start_year: int,
    income: Sequence[str] = ("income",),
    not_spending: Sequence[str] = NOT_SPENDING,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Mean monthly spending since ``start_year`` plus one month's income, less the target.

    For the users with an entry since the earlier of the two; what lies before is not read.
    """
    first = min(dt.date(start_year, 1, 1), dt.date(year, month, 1))
    flows = _month_flows(_from_month(finance, first), income, not_spending, IRREGULAR, keys)
    spend = exact_avg(F.when(F.col("year") >= start_year, F.col("spend")))
    earned = exact_sum(F.when(_is_month(dt.date(year, month, 1)), F.col("income")))
    return flows.groupBy(*keys).agg((spend + earned - F.lit(profit_target)).alias("shortfall"))


def savings_series(
    finance: DataFrame,
    profit_target: float,
    start_year: int,
    income: Sequence[str] = ("income",),
    not_spending: Sequence[str] = NOT_SPENDING,
    irregular: Sequence[str] = IRREGULAR,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Monthly net since ``start_year`` with the shortfall as of the last full month.

    The windows run over one row per user and month, never over daily rows. The December
    before is read too: a last month of January looks back to its income.
    """
    rows = _from_month(finance, dt.date(start_year - 1, 12, 1))
    flows = _month_flows(rows, income, not_spending, irregular, keys)
    user = Window.partitionBy(*keys)
    since = F.col("year") >= start_year
    shown = F.when(since & F.col("net").isNotNull(), F.col("datetime"))
    spans = flows.withColumns(
        {
            "spend_mean": exact_avg(F.when(since, F.col("spend")), over=user),
            "first_date": F.min(shown).over(user),
            "last_date": F.max(shown).over(user),
            "median_day": F.median(F.unix_date(shown)).over(user),
            "label_height": F.max(F.when(since, F.col("net"))).over(user) * 1.1,
        }
    )
    shortfall = F.col("spend_mean") + _income_before("last_date", user) - F.lit(profit_target)
    return (
        spans.withColumn("shortfall", shortfall)
        .where(since & F.col("net").isNotNull())
        .select(
            *keys,
            "year",
            "month",
            "datetime",
            F.col("net").alias("total"),
            F.lit(float(profit_target)).alias("target"),
            "shortfall",
            "first_date",
            "last_date",
            F.date_from_unix_date(F.floor("median_day").cast("int")).alias("median_date"),
            "label_height",
            half_even(F.col("shortfall"), -1).cast("bigint").alias("shortfall_tens"),
        )
    )


def spending_series(
    finance: DataFrame,
    profit_target: float,
    start_year: int,
    income: Sequence[str] = ("income",),
    not_spending: Sequence[str] = NOT_SPENDING,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Monthly spending since ``start_year`` against what income leaves after the target."""
    rows = _from_month(finance, dt.date(start_year - 1, 12, 1))
    flows = _month_flows(rows, income, not_spending, (), keys)
    user = Window.partitionBy(*keys)
    since = F.col("year") >= start_year
    shown = F.when(since & F.col("spend").isNotNull(), F.col("datetime"))
    spans = flows.withColumns(
        {
            "spend_mean": exact_avg(F.when(since, F.col("spend")), over=user),
            "last_date": F.max(shown).over(user),
        }
    )
    return (
        spans.withColumn("target", -(_income_before("last_date", user) - F.lit(profit_target)))
        .where(since & F.col("spend").isNotNull())
        .select(
            *keys,
            "year",
            "month",
            "datetime",
            F.col("spend").alias("total"),
            "target",
            (F.col("spend_mean") - F.col("target")).alias("mean_diff"),
        )
    )


def avg_monthly_by_category(
    finance: DataFrame,
    start_year: int,
    without_month: dt.date | None = None,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Mean of the monthly totals per category, optionally without the running month."""
    rows = _from_year(finance, start_year)
    if without_month:
        rows = rows.where(~_is_month(without_month))
    return category_months(rows, keys).groupBy(*keys, "category").agg(
        exact_avg("total").alias("total")
    )


def saving_mix(
    finance: DataFrame,
    housing_payment: float,
    start_year: int,
    as_of: dt.date,
    exclude: Sequence[str] = NOT_IN_MIX,
    irregular: Sequence[str] = IRREGULAR,
    income: Sequence[str] = ("income",),
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Mean month split by category plus a savings share, housing at its planned payment.

    Every monthly total counts once for its category and once for the savings
    share (share NULL), so both come out of one pass over the daily rows.
    """
    months = category_months(_from_year(finance, start_year), keys).withColumn(
        "share", F.explode(F.array(F.col("category"), F.lit(None)))
    )
    is_savings = F.col("share").isNull()
    regular = not_in("category", irregular)
    month_no = F.when(is_savings & regular, F.col("year") * 12 + F.col("month"))
    past_total = F.when(~_is_month(as_of), F.col("total"))
    shares = months.groupBy(*keys, "share").agg(
        exact_avg(past_total).alias("mean"),
        exact_avg(F.when(F.col("category") == "housing", past_total)).alias("housing"),
        exact_sum(F.when(regular, F.col("total"))).alias("net"),
        F.count_distinct(month_no).alias("months"),
    )
    mean_net = F.try_divide(F.col("net"), F.col("months").cast("double"))
    total = (
        F.when(
            is_savings,
            mean_net + (F.lit(housing_payment) - F.coalesce(F.col("housing"), F.lit(0.0))),
        )
        .when(F.col("share") == "housing", F.lit(float(housing_payment)))
        .otherwise(F.col("mean"))
    )
    shown = F.col("mean").isNotNull() & not_in("share", [*exclude, *income])
    return shares.where(is_savings | shown).select(
        *keys,
        F.coalesce("share", F.lit("savings")).alias("category"),
        F.abs(total).alias("total"),
    )


def account_pivot(
    totals: DataFrame,
    types: Sequence[str] = ("bank", "investment", "loan"),
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Mean total per account class, one column each."""
    return totals.groupBy(*keys).agg(
        *[exact_avg(F.when(F.col("account_type") == t, F.col("total"))).alias(t) for t in types]
    )


def _kpi_rows(kpis: DataFrame, shown: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Unpivot indicators, rounded to tens, with their money text."""
    return (
        kpis.unpivot(list(keys), list(shown), "variable", "value")
        .withColumn("value", half_even(F.col("value"), -1))
        .withColumn("total", money_text(F.col("value")))
    )


def account_kpis(
    totals: DataFrame,
    budget: DataFrame,
    finance: DataFrame,
    period: Period,
    not_spending: Sequence[str] = NOT_BUDGETED,
    earned: Sequence[str] = EARNED,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Balances, income, spending, budget and savings of a period, in long form."""
    flows = (
        period_filter(finance, period.monthly(), _date_column(finance))
        .dropna(subset=list(keys))
        .groupBy(*keys)
        .agg(
            exact_sum(F.when(not_in("category", not_spending), F.col("total"))).alias("spending"),
            exact_sum(F.when(F.col("category").isin(*earned), F.col("total"))).alias("paycheck"),
        )
    )
    planned = budget.dropna(subset=list(keys)).groupBy(*keys).agg(
        exact_sum("budget").alias("budget")
    )
    sides = glue([account_pivot(totals, ("bank", "investment"), keys), flows, planned], keys)
    kpis = (
        sides.fillna(0.0, ["spending", "paycheck", "budget"])
        .withColumn("delta", F.col("budget") - F.abs("spending"))
        .withColumn("savings", F.col("paycheck") + F.col("spending"))
    )
    shown = ("bank", "investment", "paycheck", "spending", "budget", "delta", "savings")
    return _kpi_rows(kpis, shown, keys)


def account_outlook(
    totals: DataFrame,
    finance: DataFrame,
    housing_payment: float,
    saving_months: int,
    start_year: int,
    income: str = "income",
    investments: str = "investments",
    everyday: Sequence[str] = EVERYDAY,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """The older indicator table: mean monthly flows and the cash reserve they call for."""
    months = category_months(_from_year(finance, start_year), keys)

    def mean_of(category: str) -> Column:
        return exact_avg(F.when(F.col("category") == category, F.col("total")))

    spending = F.lit(0.0)
    for category in everyday:
        spending = spending + F.coalesce(mean_of(category), F.lit(0.0))
    flows = months.groupBy(*keys).agg(
        mean_of(income).alias("income"),
        mean_of(investments).alias("investments"),
        spending.alias("spending"),
    )
    sides = glue([account_pivot(totals, ("bank", "credit", "investment"), keys), flows], keys)
    reserve = F.col("housing") + F.col("spending") + F.col("investments")
    kpis = (
        sides.withColumn("bank", F.col("bank") + F.coalesce(F.col("credit"), F.lit(0.0)))
        .withColumn("housing", F.lit(float(housing_payment)))
        .withColumn(
            "savings",
            F.col("income") + F.col("spending") + F.col("investments") + F.col("housing"),
        )
        .withColumn("cash savings", reserve * F.lit(saving_months) * -1)
        .withColumn("excess savings", F.col("bank") - F.col("cash savings"))
    )
    shown = (
        "bank",
        "investment",
        "cash savings",
        "excess savings",
        "income",
        "spending",
        "housing",
        "savings",
        "investments",
    )
    return _kpi_rows(kpis, shown, keys)


def quarterly_profit_loss(
    finance: DataFrame, exclude: Sequence[str] = ("bonus",), keys: Sequence[str] = KEYS
) -> DataFrame:
    """Net per quarter, dated by the quarter's first day."""
    return (
        finance.where(not_in("category", exclude))
        .dropna(subset=list(keys))
        .withColumn("quarter", F.ceil(F.col("month") / 3).cast("bigint"))
        .groupBy(*keys, "year", "quarter")
        .agg(exact_sum("total").alias("total"))
        .withColumn("month", F.col("quarter") * 3 - 2)
        .withColumn("datetime", month_start())
    )
