"""Money queries against brute-force pandas on a generated ledger."""

import datetime as dt
import random

import pandas as pd
import pytest

from tallyspark import Period
from tallyspark.operators import forward, spending

from .conftest import rows

CATEGORIES = ("income", "bonus", "groceries", "housing", "investments", "loans", "discretionary", "paycheck")


@pytest.fixture(scope="module")
def ledger_pdf():
    pick = random.Random(7)
    data = []
    for _ in range(3000):
        # One user holds about half of all rows.
        user = pick.choice(["hot", "hot", "hot", "b", "c", "d"])
        day = dt.date(2021, 1, 1) + dt.timedelta(days=pick.randrange(800))
        category = pick.choice(CATEGORIES)
        cents = pick.randrange(1, 40000) * (1 if category in ("income", "bonus", "paycheck") else -1)
        data.append((user, day.year, day.month, day.day, category, cents / 100, day))
    # A user whose only rows are bonuses, and one with a single month.
    data.append(("lone", 2022, 5, 1, "bonus", 10.0, dt.date(2022, 5, 1)))
    data.append(("once", 2022, 5, 1, "groceries", -250.0, dt.date(2022, 5, 1)))
    names = ["user", "year", "month", "day", "category", "total", "timestamp"]
    return pd.DataFrame(data, columns=names)


@pytest.fixture(scope="module")
def finance(spark, ledger_pdf):
    schema = (
        "user string, year bigint, month bigint, day bigint, category string, "
        "total double, timestamp date"
    )
    return spark.createDataFrame(list(ledger_pdf.itertuples(index=False, name=None)), schema)


@pytest.fixture(scope="module")
def budget_pdf():
    data = [("hot", "groceries", -900.0), ("hot", "housing", -50.5), ("b", "groceries", -400.0)]
    data += [("hot", "paycheck", 5000.0), ("nobody", "groceries", -1.0)]
    return pd.DataFrame(data, columns=["user", "category", "budget"])


@pytest.fixture(scope="module")
def budget(spark, budget_pdf):
    data = list(budget_pdf.itertuples(index=False, name=None))
    return spark.createDataFrame(data, "user string, category string, budget double")


def in_period(pdf, period):
    months = {"month": [period.month], "year": list(range(1, 13))}
    quarter = (period.month - 1) // 3 if period.month else 0
    months["quarter"] = [quarter * 3 + i for i in (1, 2, 3)]
    return pdf[(pdf.year == period.year) & pdf.month.isin(months[period.grain])]


PERIODS = [Period("month", 2022, month=5), Period("quarter", 2022, month=5), Period("year", 2022)]


@pytest.mark.parametrize("period", PERIODS, ids=lambda p: p.grain)
def test_spend_vs_budget(finance, budget, ledger_pdf, budget_pdf, period):
    monthly = ledger_pdf.groupby(["user", "year", "month", "category"], as_index=False).total.sum()
    joined = in_period(monthly.merge(budget_pdf, how="left", on=["user", "category"]), period)
    joined["budget"] = joined.budget.fillna(0)
    expected = joined.groupby(["user", "category"], as_index=False)[["total", "budget"]].sum()
    keep = (expected.total.abs() > 100) & ~expected.category.isin(["paycheck", "investments", "bonus"])
    expected = sorted(
        (u, c, round(t, 2), round(b, 2))
        for u, c, t, b in expected[keep].itertuples(index=False, name=None)
    )
    assert rows(spending.spend_vs_budget(finance, budget, period)) == expected


@pytest.mark.parametrize(
    "total, budget, diff, side",
    [
        (-500.0, -400.0, 100.0, "Over-Budget"),
        (-300.0, -400.0, -100.0, "Under-Budget"),
        (-400.0, -400.0, 0.0, "Over-Budget"),
        (float("inf"), -400.0, 0.0, "Over-Budget"),
    ],
)
def test_variance(spark, total, budget, diff, side):
    df = spark.createDataFrame([(total, budget)], "total double, budget double")
    row = spending.budget_variance(df).first()
    assert (row["diff"], row.positive) == (diff, side)


def test_long_form(spark):
    df = spark.createDataFrame([("a", "x", 1.0, 2.0)], "user string, category string, total double, budget double")
    assert rows(spending.spend_budget_long(df)) == [("a", "x", "budget", 2.0), ("a", "x", "total", 1.0)]


def test_month_sum(finance, ledger_pdf):
    regular = ledger_pdf[~ledger_pdf.category.isin(["bonus", "investment"])]
    expected = regular.groupby(["user", "year", "month"]).total.sum().round(2)
    found = {(r.user, r.year, r.month): r.total for r in spending.month_sum(finance).collect()}
    assert found == pytest.approx(expected.to_dict())


def shortfall(pdf, target, year, month, start):
    income = pdf[(pdf.year == year) & (pdf.month == month) & (pdf.category == "income")].total.sum()
    spend = pdf[(pdf.year >= start) & ~pdf.category.isin(["income", "bonus"])]
    return spend.groupby(["year", "month"]).total.sum().mean() + income - target


def test_budget_shortfall(finance, ledger_pdf):
    found = spending.budget_shortfall(finance, 3000, 2022, 5, 2022)
    found = {r.user: r.shortfall for r in found.collect()}
    assert found.pop("lone") is None
    for user, value in found.items():
        mine = ledger_pdf[ledger_pdf.user == user]
        assert value == pytest.approx(shortfall(mine, 3000, 2022, 5, 2022))


def test_monthly_income_is_zero_without_rows(finance, ledger_pdf):
    found = {r.user: r.income for r in spending.monthly_income(finance, 2022, 5).collect()}
    assert set(found) == set(ledger_pdf.user)
    assert found["lone"] == found["once"] == 0.0
    mine = ledger_pdf[(ledger_pdf.user == "hot") & (ledger_pdf.category == "income")]
    assert found["hot"] == pytest.approx(mine[(mine.year == 2022) & (mine.month == 5)].total.sum())


def previous_month(day):
    return (day.year - 1, 12) if day.month == 1 else (day.year, day.month - 1)


def test_savings_series(finance, ledger_pdf):
    found = spending.savings_series(finance, 3000, 2022).toPandas()
    assert "lone" not in set(found.user)
    for user, mine in ledger_pdf.groupby("user"):
        if user == "lone":
            continue
        regular = mine[~mine.category.isin(["bonus", "investment"]) & (mine.year >= 2022)]
        months = regular.groupby(["year", "month"]).total.sum()
        got = found[found.user == user].set_index(["year", "month"])
        assert got.total.to_dict() == pytest.approx(months.to_dict())
        dates = sorted(dt.date(y, m, 1) for y, m in months.index)
        assert set(got.first_date) == {dates[0]} and set(got.last_date) == {dates[-1]}
        middle = pd.to_datetime(pd.Series(dates)).median().date()
        assert set(got.median_date) == {middle}
        assert got.label_height.iloc[0] == pytest.approx(months.max() * 1.1)
        year, month = previous_month(dates[-1])
        expected = shortfall(mine, 3000, year, month, 2022)
        assert got.shortfall.iloc[0] == pytest.approx(expected)
        assert got.shortfall_tens.iloc[0] == int(round(expected, -1))


def test_spending_series(finance, ledger_pdf):
    found = spending.spending_series(finance, 3000, 2022).toPandas()
    mine = ledger_pdf[ledger_pdf.user == "hot"]
    spend = mine[(mine.year >= 2022) & ~mine.category.isin(["income", "bonus"])]
    months = spend.groupby(["year", "month"]).total.sum()
    got = found[found.user == "hot"].set_index(["year", "month"])
    assert got.total.to_dict() == pytest.approx(months.to_dict())
    year, month = previous_month(max(dt.date(y, m, 1) for y, m in months.index))
    income = mine[(mine.year == year) & (mine.month == month) & (mine.category == "income")].total.sum()
    assert got.target.iloc[0] == pytest.approx(-(income - 3000))
    assert got.mean_diff.iloc[0] == pytest.approx(months.mean() + (income - 3000))


def test_saving_mix(finance, ledger_pdf):
    now = dt.date(2022, 12, 9)
    found = spending.saving_mix(finance, -800.0, 2022, now)
    found = {(r.user, r.category): r.total for r in found.collect()}
    for user in ("hot", "b", "once"):
        mine = ledger_pdf[(ledger_pdf.user == user) & (ledger_pdf.year >= 2022)]
        past = mine[~((mine.year == now.year) & (mine.month == now.month))]
        monthly = past.groupby(["year", "month", "category"]).total.sum()
        mean = monthly.groupby("category").mean()
        net = mine[~mine.category.isin(["bonus", "investment"])].groupby(["year", "month"]).total.sum()
        expected = mean.drop(["bonus", "loans", "music", "income"], errors="ignore").to_dict()
        if "housing" in expected:
            expected["housing"] = -800.0
        expected["savings"] = net.mean() + (-800.0 - mean.get("housing", 0.0))
        got = {c: t for (u, c), t in found.items() if u == user}
        assert got == pytest.approx({c: abs(t) for c, t in expected.items()})


def test_account_kpis(spark, finance, budget, ledger_pdf, budget_pdf):
    totals = spark.createDataFrame(
        [("hot", "bank", 1234.56), ("hot", "investment", 125.0), ("hot", "loan", 5.0), ("saver", "bank", 9.0)],
        "user string, account_type string, total double",
    )
    period = Period("month", 2022, month=5)
    found = spending.account_kpis(totals, budget, finance, period)
    found = {(r.user, r.variable): (r.value, r.total) for r in found.collect()}
    mine = in_period(ledger_pdf[ledger_pdf.user == "hot"], period)
    spend = mine[~mine.category.isin(["paycheck", "investments", "bonus"])].total.sum()
    income = mine[mine.category.isin(["paycheck", "bonus"])].total.sum()
    planned = budget_pdf[budget_pdf.user == "hot"].budget.sum()
    expected = {
        "bank": 1230.0,
        "investment": 120.0,
        "paycheck": round(income, -1),
        "spending": round(spend, -1),
        "budget": round(planned, -1),
        "delta": round(planned - abs(spend), -1),
        "savings": round(income + spend, -1),
    }
    for name, value in expected.items():
        assert found["hot", name] == (value, f"${value:,.0f}"), name
    # Users known from one side only still have a full set of rows.
    assert found["saver", "bank"] == (10.0, "$10")
    assert found["saver", "savings"] == (0.0, "$0")
    assert found["nobody", "bank"] == (None, None)


def test_account_outlook(spark, finance, ledger_pdf):
    totals = spark.createDataFrame(
        [("hot", "bank", 900.0), ("hot", "credit", -100.0), ("hot", "investment", 55.0)],
        "user string, account_type string, total double",
    )
    found = spending.account_outlook(totals, finance, -700.0, 6, 2022)
    found = {r.variable: r.value for r in found.where("user = 'hot'").collect()}
    mine = ledger_pdf[(ledger_pdf.user == "hot") & (ledger_pdf.year >= 2022)]
    mean = mine.groupby(["year", "month", "category"]).total.sum().groupby("category").mean()
    spend = mean["discretionary"] + mean["groceries"]
    reserve = -(-700.0 + spend + mean["investments"]) * 6
    expected = {
        "bank": 800.0,
        "investment": 55.0,
        "cash savings": reserve,
        "excess savings": 800.0 - reserve,
        "income": mean["income"],
        "spending": spend,
        "housing": -700.0,
        "savings": mean["income"] + spend + mean["investments"] - 700.0,
        "investments": mean["investments"],
    }
    assert found == {k: round(v, -1) for k, v in expected.items()}


def test_quarterly_profit_loss(finance, ledger_pdf):
    found = spending.quarterly_profit_loss(finance)
    found = {(r.user, r.year, r.quarter): (r.total, r.datetime) for r in found.collect()}
    regular = ledger_pdf[ledger_pdf.category != "bonus"]
    quarter = (regular.month - 1) // 3 + 1
    expected = regular.groupby(["user", "year", quarter]).total.sum()
    assert set(found) == set(expected.index)
    for (user, year, q), total in expected.items():
        assert found[user, year, q] == (pytest.approx(total), dt.date(year, 3 * q - 2, 1))


def test_forward_budget(finance, ledger_pdf):
    found = forward.forward_budget(finance, 2022)
    found = {(r.user, r.variable): (r.spending, r.income, r.profit) for r in found.collect()}
    recent = ledger_pdf[ledger_pdf.year >= 2022]
    for user in ("hot", "b", "c", "d"):
        mine = recent[recent.user == user]

        def months(rows_):
            return rows_.groupby(["year", "month"]).total.sum()

        series = (
            months(mine[~mine.category.isin(["paycheck", "bonus"])]),
            months(mine[mine.category == "paycheck"]),
            months(mine[mine.category != "bonus"]),
        )
        assert found[user, "mean"] == pytest.approx(tuple(s.mean() for s in series))
        low = tuple(s.describe()["25%"] for s in series)
        assert found[user, "25%"] == pytest.approx(low, abs=1e-4)
    # Users without all three series are not in the natural join.
    assert not {u for u, _ in found} & {"lone", "once"}


def test_forward_stats_interpolates(spark):
    df = spark.createDataFrame([("a", x) for x in (1.0, 2.0, 3.0, 10.0)], "user string, total double")
    assert rows(forward.forward_stats(df, "spending")) == [("a", "25%", 1.75), ("a", "mean", 4.0)]


@pytest.mark.parametrize(
    "build",
    [
        lambda f, k: spending.month_sum(f, keys=k),
        lambda f, k: spending.savings_series(f, 3000, 2022, keys=k),
        lambda f, k: spending.spending_series(f, 3000, 2022, keys=k),
        lambda f, k: spending.saving_mix(f, -800.0, 2022, dt.date(2022, 12, 9), keys=k),
        lambda f, k: spending.budget_shortfall(f, 3000, 2022, 5, 2022, keys=k),
        lambda f, k: spending.monthly_income(f, 2022, 5, keys=k),
        lambda f, k: spending.quarterly_profit_loss(f, keys=k),
        lambda f, k: spending.avg_monthly_by_category(f, 2022, keys=k),
        lambda f, k: forward.forward_budget(f, 2022, keys=k),
    ],
)
def test_one_user_alone_equals_that_user_among_many(finance, build):
    among = build(finance, ("user",)).where("user = 'hot'").drop("user")
    alone = build(finance.where("user = 'hot'").drop("user"), ())
    assert rows(among, *alone.columns) == rows(alone)


@pytest.mark.parametrize("keys", [("user",), ()])
def test_series_that_end_in_january(spark, keys):
    """The month before a last January is December of the year before, though not shown."""
    data = [("a", 2023, 12, 5, "income", 1000.0, dt.date(2023, 12, 5)), ("a", 2024, 1, 3, "food", -200.0, dt.date(2024, 1, 3))]
    kind = "user string, year bigint, month bigint, day bigint, category string, total double, timestamp date"
    ledger = spark.createDataFrame(data, kind)
    saved = spending.savings_series(ledger, 100, 2024, keys=keys).collect()
    assert [(r.month, r.shortfall) for r in saved] == [(1, 700.0)]
    spent = spending.spending_series(ledger, 100, 2024, keys=keys).collect()
    assert [(r.month, r.target) for r in spent] == [(1, -900.0)]
