import datetime as dt

import pytest

from tallyspark.operators import ledger
from tallyspark.operators.joins import glue, tag_users

from .conftest import rows


@pytest.fixture(scope="module")
def categories(spark):
    return spark.createDataFrame(
        [
            ("income", "paycheck", "Salary"),
            ("spending", "groceries", "Food"),
            ("spending", "groceries", "Market"),
            ("saving", "groceries", "Food"),
        ],
        "meta_category string, category string, name string",
    )


@pytest.fixture(scope="module")
def transactions(spark):
    return spark.createDataFrame(
        [
            ("a", "2024-01-05", -10.10, "Food", "Root"),
            ("a", "2024-01-05", -20.20, "Market", "Living"),
            ("a", "2024-01-05", 5.0, "Unknown", "Root"),
            ("a", "2024-01-06", 1000.0, "Salary", "Work"),
            ("b", "2024-01-05", -1.0, "Food", "Living"),
            ("b", None, -7.0, "Food", "Living"),
            ("b", "2024-01-05", None, "Food", None),
        ],
        "user string, date string, amount double, name string, parentName string",
    )


def test_daily_finances(transactions, categories):
    daily = ledger.daily_finances(transactions, categories)
    day = dt.date(2024, 1, 5)
    assert rows(daily) == [
        ("a", 2024, 1, 5, "groceries", -30.3, day),
        ("a", 2024, 1, 6, "paycheck", 1000.0, dt.date(2024, 1, 6)),
        ("b", 2024, 1, 5, "groceries", -1.0, day),
    ]


def test_per_user_categories(spark, transactions):
    own = spark.createDataFrame(
        [("a", "food", "Food"), ("b", "snacks", "Food")], "user string, category string, name string"
    )
    daily = ledger.daily_finances(transactions, own)
    assert rows(daily, "user", "category", "total") == [("a", "food", -10.1), ("b", "snacks", -1.0)]


def test_root_parent_fill(transactions):
    filled = ledger.root_parent_fill(transactions)
    assert rows(filled.where("user = 'a'"), "name", "parentName") == [
        ("Food", "Food"),
        ("Market", "Living"),
        ("Salary", "Work"),
        ("Unknown", "Unknown"),
    ]


def test_category_dim_fans_out_over_meta_categories(categories):
    meta = categories.select("meta_category", "category").distinct()
    names = categories.select("category", "name").distinct()
    dim = ledger.category_dim(meta, names, keys=())
    assert len(rows(dim.where("name = 'Food'"))) == 2


def test_monthly_budget(spark, categories):
    budgets = spark.createDataFrame(
        [
            ("a", "2024-01-01", 1.0, 400.0, "Food"),
            ("a", "2024-02-01", 1.0, 300.0, "Food"),
            ("a", "2024-02-01", 1.0, 300.0, "Food"),
            ("a", "2024-02-01", 2.0, 50.0, "Market"),
            ("a", "2024-02-01", 2.0, 2000.0, "Salary"),
            ("b", "2024-01-01", 1.0, 90.0, "Food"),
            ("c", "2024-01-01", 1.0, 10.0, "Food"),
            ("c", "2024-02-01", 1.0, 10.0, "Unmapped"),
        ],
        "user string, budgetDate string, amount double, budgetAmount double, name string",
    )
    # The older date of user c is not used even though the newest has only an unmapped name.
    assert rows(ledger.monthly_budget(budgets, categories)) == [
        ("a", "groceries", -350.0),
        ("a", "paycheck", 2000.0),
        ("b", "groceries", -90.0),
    ]
    assert rows(ledger.budget_by_user(ledger.monthly_budget(budgets, categories))) == [
        ("a", 1650.0),
        ("b", -90.0),
    ]


def test_account_totals(spark):
    accounts = spark.createDataFrame(
        [
            ("a", "CreditAccount", "ACTIVE", -50.5),
            ("a", "BankAccount", "ACTIVE", 100.0),
            ("a", "CashAccount", "CLOSED", 7.0),
            ("a", "InvestmentAccount", "ACTIVE", 10.0),
            ("a", "LoanAccount", "ACTIVE", None),
            ("a", "VehicleAccount", "ACTIVE", 1.0),
            ("a", None, "ACTIVE", 2.0),
        ],
        "user string, type string, systemStatus string, currentBalance double",
    )
    assert rows(ledger.account_totals(accounts)) == [
        ("a", "bank", 49.5),
        ("a", "investment", 10.0),
        ("a", "loan", 0.0),
        ("a", "other", 3.0),
    ]
    apart = ledger.account_totals(accounts, credit_apart=True)
    assert ("a", "credit", -50.5) in rows(apart)


def test_glue_keeps_every_key(spark):
    left = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "user string, x double")
    right = spark.createDataFrame([("b", 3.0), ("c", 4.0)], "user string, y double")
    assert rows(glue([left, right], ["user"])) == [("a", 1.0, None), ("b", 2.0, 3.0), ("c", None, 4.0)]
    assert rows(glue([left.select("x").limit(1), right.select("y").limit(1)], [])) == [(1.0, 3.0)]


def test_tag_users(spark):
    a = spark.createDataFrame([(1.0,)], "total double")
    b = spark.createDataFrame([(2.0, "x")], "total double, note string")
    assert rows(tag_users({"a": a, "b": b}), "user", "total", "note") == [
        ("a", 1.0, None),
        ("b", 2.0, "x"),
    ]


def test_invariants_on_given_tables(spark):
    from tallyspark.plans.standins import StandIns

    s = StandIns(spark, "/root/testdata/sf0.001")
    daily = ledger.daily_finances(s.transactions, s.categories)
    assert daily.count() > 100
    assert {"year", "month", "category", "total"} <= set(daily.columns)
    total = daily.groupBy().sum("total").first()[0]
    raw = s.transactions.join(s.categories, "name", "left_semi").groupBy().sum("amount").first()[0]
    assert total == pytest.approx(raw)
