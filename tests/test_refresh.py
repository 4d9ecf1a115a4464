"""Landed files to snapshots to dashboard, end to end."""

import datetime as dt
import json
import re

import pytest

from tallyspark import Period
from tallyspark.operators import attributes, scorecard, spending, tasks
from tallyspark.plans import refresh
from tallyspark.plans.views import scored_table
from tallyspark.sources import config
from tallyspark.sources.snapshots import latest_snapshot, list_snapshots

from .conftest import rows
from .test_sources import EXPORT

DAY1, DAY2 = dt.date(2024, 2, 1), dt.date(2024, 2, 2)
JAN_2 = 1704189600000  # 2024-01-02 10:00


@pytest.fixture(scope="module")
def landing(tmp_path_factory):
    root = tmp_path_factory.mktemp("landing")

    def land(name, *docs):
        (root / name).mkdir()
        text = "\n".join(json.dumps({"user": "ann", **d}) for d in docs)
        (root / name / "part.json").write_text(text)

    land(
        "transactions",
        {"date": "2024-01-03", "amount": -150.25, "category": {"name": "Food", "parentName": "Root"}},
        {"date": "2024-01-20", "amount": -50.0, "category": {"name": "Food", "parentName": "Root"}},
        {"date": "2024-01-31", "amount": 3000, "category": {"name": "Salary", "parentName": "Root"}},
    )
    land("budgets", {"budgetDate": "2024-01-01", "category": {"name": "Food"}, "amount": 1, "budgetAmount": 150})
    land("accounts", {"name": "x", "type": "BankAccount", "systemStatus": "ACTIVE", "currentBalance": 5000.0})
    land("investments", {"description": "fund", "currentValue": 10.0})
    land(
        "docs",
        {"db": "Categories", "_id": "w", "parentId": "root", "title": "Work"},
        {"db": "Categories", "_id": "p", "parentId": "w", "title": "Project"},
        {"db": "Tasks", "title": "t", "day": "2024-01-05", "parentId": "p", "times": [JAN_2, JAN_2], "duration": 10800000},
        {"db": "Habits", "id": "1", "title": "run", "isPositive": True, "target": 1, "period": "week", "history": [JAN_2, 2]},
    )
    land("attribute_pages", {"page_no": 1, "results": [{"label": "Mood", "values": [{"date": "2024-01-02", "value": 7}]}]})
    (root / "health_export").mkdir()
    (root / "health_export" / "ann.xml").write_text(EXPORT)
    (root / "config").mkdir()
    document = {
        "aggregate_categories": {"groceries": ["Food"], "paycheck": ["Salary"]},
        "meta_categories": {"spending": ["groceries"], "income": ["paycheck"]},
        "attribute_config": {"key_habits": {"mood": 8}},
        "task_config": {"aggregate_categories": ["Work"]},
    }
    (root / "config" / "ann_config.json").write_text(json.dumps(document))
    return str(root)


@pytest.fixture(scope="module")
def root(spark, landing, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("snapshots"))
    refresh.refresh(spark, landing, path, DAY1)
    return path


def test_money(spark, root):
    daily = latest_snapshot(spark, root, "daily_finances")
    budget = latest_snapshot(spark, root, "monthly_budget")
    spent = spending.spend_vs_budget(daily, budget, Period("month", 2024, month=1))
    assert rows(spending.budget_variance(spent)) == [
        ("ann", "groceries", -200.25, -150.0, 50.25, "Over-Budget")
    ]
    totals = latest_snapshot(spark, root, "account_totals")
    kpis = spending.account_kpis(totals, budget, daily, Period("month", 2024, month=1))
    assert ("ann", "savings", "$2,800") in rows(kpis, "user", "variable", "total")


def test_scorecard(spark, root, landing):
    settings = config.read_config(spark, f"{landing}/config")
    table = scored_table(
        latest_snapshot(spark, root, "habits"),
        latest_snapshot(spark, root, "attributes"),
        config.habit_targets(settings),
        latest_snapshot(spark, root, "sleep_data"),
        DAY1,
    )
    base = scorecard.scorecard_base(table, Period("week", 2024, week=1))
    assert rows(scorecard.scorecard_success(base), "name", "value", "target") == [("run", 2.0, 1.0)]
    assert rows(scorecard.scorecard_fail(base), "name", "value", "target") == [("Rating", 7.0, 8.0)]
    assert rows(scorecard.supporting_table(base), "name", "value") == [
        ("Bed", "11:00 PM"),
        ("Duration", "07:30"),
        ("Wake", "06:30 AM"),
    ]


def test_tasks(spark, root, landing):
    rollup = config.task_rollup_set(config.read_config(spark, f"{landing}/config"))
    formatted = tasks.format_tasks(latest_snapshot(spark, root, "tasks"), rollup)
    found = tasks.task_time_by_category(formatted, 2024, 1)
    assert rows(found, "user", "category", "duration") == [("ann", "Work", 3.0)]


def pushed(df, column):
    """Filters on a column that reach a file scan."""
    text = df._jdf.queryExecution().executedPlan().toString()
    found = re.findall(r"PushedFilters: \[([^\]]*)\]", text)
    return [f for f in found if f"GreaterThanOrEqual({column}," in f]


def test_periods_reach_the_files(spark, root, landing):
    settings = config.read_config(spark, f"{landing}/config")
    daily = latest_snapshot(spark, root, "daily_finances")
    income = spending.monthly_income(daily, 2024, 1, users=daily.select("user"))
    assert "LessThan(timestamp,2024-02-01)" in pushed(income, "timestamp")[0]
    assert pushed(spending.budget_shortfall(daily, 100, 2024, 1, 2024), "timestamp")
    values = latest_snapshot(spark, root, "attributes")
    formatted = attributes.format_attributes(values, config.habit_targets(settings), DAY1)
    assert pushed(attributes.habit_achievement(formatted, 2024, 1, DAY1), "date")
    shown = tasks.format_tasks(latest_snapshot(spark, root, "tasks"), config.task_rollup_set(settings))
    assert pushed(tasks.task_time_by_category(shown, 2024, 1), "day")


def test_second_refresh_makes_the_first_removable(spark, root, landing):
    before = spark.createDataFrame(list_snapshots(spark, root, refresh.DATASETS).collect())
    assert refresh.stale_after_refresh(spark, root, before).count() == 0
    refresh.refresh(spark, landing, root, DAY2)
    stale = refresh.stale_after_refresh(spark, root, before)
    assert rows(stale) == sorted((d, "ann", DAY1) for d in refresh.DATASETS)
    # The days it replaced are gone, with their lists of users.
    left = list_snapshots(spark, root, refresh.DATASETS).collect()
    assert {(r.dataset, r.snapshot_date) for r in left} == {(d, DAY2) for d in refresh.DATASETS}
    assert latest_snapshot(spark, root, "account_totals", user="ann").count() > 0
