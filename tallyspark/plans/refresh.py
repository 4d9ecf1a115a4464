"""The batch refresh: landed records in, dated snapshots out."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from tallyspark.operators.habits import habit_history
from tallyspark.operators.ledger import account_totals, daily_finances, monthly_budget
from tallyspark.operators.sleep import sleep_nights
from tallyspark.plans.views import tasks_from_docs
from tallyspark.sources import config, landed
from tallyspark.sources.snapshots import (
    drop_snapshots,
    list_snapshots,
    removable_dates,
    retention_plan,
    write_snapshot,
)
from tallyspark.sources.workspace import settle

DATASETS = (
    "daily_finances",
    "monthly_budget",
    "account_totals",
    "investments",
    "tasks",
    "habits",
    "attributes",
    "sleep_data",
)

# Event-like datasets lie in the order their readers ask for.
CLUSTER_BY = {
    "daily_finances": ("user", "timestamp"),
    "tasks": ("user", "day"),
    "habits": ("user", "timestamp"),
    "attributes": ("user", "date"),
    "sleep_data": ("user", "wakeup"),
}


def build_datasets(
    spark: SparkSession, landing: str, categories: DataFrame
) -> dict[str, DataFrame]:
    """Every snapshot dataset, lazily, from a landing folder with one subfolder per input."""
    docs = landed.read_docs(spark, f"{landing}/docs")
    pages = landed.read_attribute_pages(spark, f"{landing}/attribute_pages")
    return {
        "daily_finances": daily_finances(
            landed.read_transactions(spark, f"{landing}/transactions"), categories
        ),
        "monthly_budget": monthly_budget(
            landed.read_budgets(spark, f"{landing}/budgets"), categories
        ),
        "account_totals": account_totals(landed.read_accounts(spark, f"{landing}/accounts")),
        "investments": landed.read_investments(spark, f"{landing}/investments"),
        "tasks": tasks_from_docs(
            landed.select_docs(docs, "Tasks"), landed.select_docs(docs, "Categories")
        ),
        "habits": habit_history(landed.select_docs(docs, "Habits")),
        "attributes": landed.read_attributes(pages),
        "sleep_data": sleep_nights(landed.read_sleep_xml(spark, f"{landing}/health_export")),
    }


def refresh(
    spark: SparkSession, landing: str, root: str, as_of: dt.date, drop_old: bool = True
) -> int:
    """Write the day's snapshot of every dataset, then drop the days it replaces.

    A day goes only once every user in it was refreshed in every dataset. Returns how many went.
    """
    before = settle(list_snapshots(spark, root, DATASETS), "listing")
    categories = config.category_dim_of(config.read_config(spark, f"{landing}/config"))
    for dataset, df in build_datasets(spark, landing, categories).items():
        write_snapshot(df, root, dataset, as_of, CLUSTER_BY.get(dataset, ()))
    if not drop_old:
        return 0
    listing = list_snapshots(spark, root, DATASETS)
    old = removable_dates(listing, retention_plan(before, listing))
    return drop_snapshots(spark, root, settle(old, "removable"))


def stale_after_refresh(
    spark: SparkSession, root: str, before: DataFrame, datasets: tuple[str, ...] = DATASETS
) -> DataFrame:
    """What the refresh made removable, given the listing taken before it."""
    return retention_plan(before, list_snapshots(spark, root, datasets))
