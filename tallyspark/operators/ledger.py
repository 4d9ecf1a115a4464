"""From raw bank records to the daily, budget and account tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import as_date, date_parts, exact_sum, shared_keys
from tallyspark.functions.expressions import beyond, exact

KEYS = ("user",)

# Which class each known account type belongs to.
ACCOUNT_CLASSES = {
    "bank": ("CreditAccount", "BankAccount", "CashAccount"),
    "investment": ("InvestmentAccount",),
    "loan": ("LoanAccount",),
}


def root_parent_fill(transactions: DataFrame) -> DataFrame:
    """A category directly under the root is its own parent."""
    parent = F.when(F.col("parentName") == "Root", F.col("name")).otherwise(F.col("parentName"))
    return transactions.withColumn("parentName", parent)


def classify_accounts(accounts: DataFrame, credit_apart: bool = False) -> DataFrame:
    """Add ``account_type``; unknown types are ``other``.

    ``credit_apart`` gives credit accounts a class of their own, as the older
    indicator table expects.
    """
    label: Column = F.lit("other")
    for name, types in ACCOUNT_CLASSES.items():
        label = F.when(F.col("type").isin(*types), F.lit(name)).otherwise(label)
    if credit_apart:
        label = F.when(F.col("type") == "CreditAccount", F.lit("credit")).otherwise(label)
    return accounts.withColumn("account_type", label)


def category_dim(meta: DataFrame, aggregate: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """meta(meta_category, category) joined to aggregate(category, name)."""
    on = [*shared_keys(meta, shared_keys(aggregate, keys)), "category"]
    return meta.join(aggregate, on).select(
        *[k for k in on if k != "category"], "meta_category", "category", "name"
    )


def name_to_category(categories: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per name and category, so a category under two meta categories counts once."""
    return categories.select(*shared_keys(categories, keys), "name", "category").distinct()


def daily_finances(
    transactions: DataFrame, categories: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Total per day and category. Transactions with an unmapped name drop out.

    Transactions are added up per day and name before the join, which combines map-side: raw
    rows of a heavy user never meet in a join. No broadcast hint: the mapping is per user on a
    real cluster and grows with the users; Catalyst broadcasts it below the threshold.
    """
    mapping = name_to_category(categories, keys)
    dated = transactions.select(
        *keys, as_date(transactions, "date").alias("timestamp"), "name", "amount"
    )
    reduced = (
        dated.dropna(subset=[*keys, "timestamp", "name"])
        .groupBy(*keys, "timestamp", "name")
        .agg(F.sum(exact("amount")).alias("held"), F.sum(beyond("amount")).alias("rest"))
    )
    held, rest = F.sum("held").cast("double"), F.sum("rest")
    daily = (
        reduced.join(mapping, [*shared_keys(categories, keys), "name"])
        .dropna(subset=["category"])
        .groupBy(*keys, "timestamp", "category")
        .agg((F.coalesce(held, F.lit(0.0)) + F.coalesce(rest, F.lit(0.0))).alias("total"))
    )
    return daily.select(
        *keys, *date_parts("timestamp", "year", "month", "day"), "category", "total", "timestamp"
    )


def current_budgets(budgets: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Distinct rows of each user's newest budget date.

    Deduplicated first, on the whole row, which spreads a heavy user over all tasks; the
    newest date is then joined in an exchange of its own, which adaptive splitting can act on.
    """
    dated = budgets.withColumn("budgetDate", as_date(budgets, "budgetDate"))
    newest = dated.groupBy(*keys).agg(F.max("budgetDate").alias("budgetDate"))
    return dated.dropDuplicates().join(newest, [*keys, "budgetDate"], "left_semi")


def monthly_budget(
    budgets: DataFrame, categories: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Current budget per category, spending negative, paychecks positive."""
    amount = F.when(F.col("category") == "paycheck", F.col("budget")).otherwise(-F.col("budget"))
    return (
        current_budgets(budgets, keys)
        .join(name_to_category(categories, keys), [*shared_keys(categories, keys), "name"])
        .dropna(subset=["category"])
        .groupBy(*keys, "category")
        .agg(exact_sum("budgetAmount").alias("budget"))
        .withColumn("budget", amount)
    )


def account_totals(
    accounts: DataFrame, keys: Sequence[str] = KEYS, credit_apart: bool = False
) -> DataFrame:
    """Balance of the active accounts per account class."""
    return (
        classify_accounts(accounts, credit_apart)
        .where(F.col("systemStatus") == "ACTIVE")
        .dropna(subset=list(keys))
        .groupBy(*keys, "account_type")
        .agg(exact_sum("currentBalance").alias("total"))
    )


def budget_by_user(budget: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return budget.groupBy(*keys).agg(exact_sum("budget").alias("budget"))
