import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tallyspark.sources import config, landed, snapshots

from .conftest import rows


def lines(tmp_path, *docs):
    path = tmp_path / "docs.json"
    path.write_text("\n".join(json.dumps(d) for d in docs))
    return str(path)


def test_read_accounts(spark, tmp_path):
    path = lines(
        tmp_path,
        {"user": "a", "name": "n", "type": "BankAccount", "systemStatus": "ACTIVE", "currentBalance": 1.5, "extra": 1},
        {"user": "a", "name": "m"},
    )
    found = landed.read_accounts(spark, path)
    assert rows(found, "name", "type", "currentBalance", "availableBalance") == [
        ("m", None, None, None),
        ("n", "BankAccount", 1.5, None),
    ]


def test_read_transactions_flattens_the_category(spark, tmp_path):
    path = lines(
        tmp_path,
        {"user": "a", "date": "2024-01-01", "amount": -1, "category": {"name": "Food", "parentName": "Root", "id": 3}},
        {"user": "a", "date": "2024-01-02", "amount": 2.5, "category": None},
    )
    found = landed.read_transactions(spark, path)
    assert rows(found, "date", "amount", "name", "parentName") == [
        ("2024-01-01", -1.0, "Food", "Root"),
        ("2024-01-02", 2.5, None, None),
    ]


def test_read_investments_with_and_without_symbol(spark, tmp_path):
    path = lines(
        tmp_path,
        {"user": "a", "description": "x", "symbol": "XX", "currentValue": 1.0},
        {"user": "a", "description": "y", "currentValue": 2.0},
    )
    found = landed.read_investments(spark, path)
    assert "symbol" not in found.columns
    assert rows(found, "description", "currentValue") == [("x", 1.0), ("y", 2.0)]


def test_read_budgets(spark, tmp_path):
    path = lines(tmp_path, {"user": "a", "budgetDate": "2024-01-01", "category": {"name": "Food"}, "amount": 3, "budgetAmount": 4})
    assert rows(landed.read_budgets(spark, path)) == [("a", "2024-01-01", 3.0, 4.0, "Food")]


def test_docs_by_kind(spark, tmp_path):
    path = lines(
        tmp_path,
        {"user": "a", "db": "Tasks", "title": "t", "times": [1, 2]},
        {"user": "a", "db": "Habits", "title": "h", "history": [1, 2.5]},
    )
    docs = landed.read_docs(spark, path)
    assert [r.title for r in landed.select_docs(docs, "Habits").collect()] == ["h"]


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    def page(number, *results, following=None):
        values = [
            {"label": label, "values": [{"date": d, "value": v} for d, v in vs]}
            for label, vs in results
        ]
        return {"user": "a", "page_no": number, "results": values, "next": following}

    path = lines(
        tmp_path_factory.mktemp("pages"),
        page(1, ("Mood", [("2024-01-01", 5), ("2024-01-02", 6)]), ("Steps", []), following="2"),
        page(2, ("Mood", [("2024-02-01", 7)]), ("Weight", [("2024-02-01", None)])),
    )
    return landed.read_attribute_pages(spark, path)


def test_read_attributes(pages):
    assert rows(landed.read_attributes(pages)) == [
        ("a", dt.date(2024, 1, 1), 5.0, "Mood"),
        ("a", dt.date(2024, 1, 2), 6.0, "Mood"),
        ("a", dt.date(2024, 2, 1), None, "Weight"),
        ("a", dt.date(2024, 2, 1), 7.0, "Mood"),
    ]


def test_latest_attribute_values(pages):
    found = rows(landed.latest_attribute_values(pages), "attribute", "value")
    assert found == [("Mood", "7"), ("Weight", None)]


def test_latest_attribute_values_has_no_cap_on_page_or_place(spark):
    def result(label, date, value):
        return {"label": label, "values": [{"date": date, "value": value}]}

    # Under a cap the losers below would tie with the winners and win by their greater values.
    filler = [result("Pad", "2024-01-01", "6")] * 70_000
    data = [
        {"user": "a", "page_no": 1 << 26, "results": [result("Mood", "2024-03-01", "2")] * 2},
        {"user": "a", "page_no": (1 << 26) + 1, "results": [result("Mood", "2024-03-01", "1")]},
        {"user": "a", "page_no": 1, "results": [*filler, result("Pad", "2024-01-01", "5")]},
        {"user": "a", "page_no": 1, "results": [result("Pad", "2024-01-01", "9")]},
        {"user": "a", "page_no": 5, "results": [result("Odd", "bad", "8"), result("Odd", "2020-01-01", "3")]},
        {"user": "a", "page_no": None, "results": [result("Null", "2024-01-01", "4")]},
    ]
    pages = spark.createDataFrame(data, landed.schemas.ATTRIBUTE_PAGES)
    found = rows(landed.latest_attribute_values(pages), "attribute", "value")
    # Page 2^26 + 1 beats 2^26; place 70,000 beats place 0 on the same page and date.
    assert found == [("Mood", "1"), ("Null", "4"), ("Odd", "3"), ("Pad", "5")]


EXPORT = """<?xml version="1.0" encoding="UTF-8"?>
<HealthData locale="en_US">
 <Me key="x"/>
 <Record type="HKCategoryTypeIdentifierSleepAnalysis" sourceName="Phone" startDate="2024-01-01 23:00:00 -0500" endDate="2024-01-02 06:30:00 -0500" value="InBed">
  <MetadataEntry key="zone" value="x"/>
 </Record>
 <Record type="HKQuantityTypeIdentifierStepCount" startDate="2024-01-02 08:00:00 -0500" endDate="2024-01-02 08:10:00 -0500" value="7"/>
 <Record type="HKCategoryTypeIdentifierSleepAnalysis" startDate="bad" endDate="2024-01-03 06:30:00 -0500"/>
</HealthData>
"""


def test_read_sleep_xml(spark, tmp_path):
    (tmp_path / "ann.xml").write_text(EXPORT)
    found = landed.read_sleep_xml(spark, str(tmp_path))
    assert rows(found.select("user", "start_wall", "end_wall", F.unix_seconds("sleep_start"))) == [
        ("ann", None, dt.datetime(2024, 1, 3, 6, 30), None),
        ("ann", dt.datetime(2024, 1, 1, 23), dt.datetime(2024, 1, 2, 6, 30), 1704168000),
    ]


@pytest.mark.parametrize(
    "end, months",
    [("2021-12-01", 0), ("2021-12-02", 1), ("2021-12-31", 1), ("2022-01-01", 2), ("2022-03-01", 3)],
)
def test_month_calendar(spark, end, months):
    span = spark.sql(f"SELECT 'a' AS user, DATE '2021-12-01' AS first, DATE '{end}' AS last")
    found = rows(landed.month_calendar(span, "first", "last"), "month_end", "days")
    ends = [(dt.date(2021, 12, 31), 31), (dt.date(2022, 1, 31), 31), (dt.date(2022, 2, 28), 28)]
    assert found == ends[:months]


def test_config(spark, tmp_path):
    document = {
        "bank_login": {"password": "secret"},
        "aggregate_categories": {"groceries": ["Food", None, "Market"], "music": []},
        "meta_categories": {"spending": ["groceries", "housing"], "fun": ["groceries"]},
        "tracker": {"key_habits": {"mood": 5, "steps": 1.5}},
        "todo": {"aggregate_categories": ["Work", "Home"]},
    }
    (tmp_path / "ann_config.json").write_text(json.dumps(document, indent=2))
    found = config.read_config(
        spark, str(tmp_path), targets="tracker.key_habits", rollup="todo.aggregate_categories"
    )
    assert "secret" not in str(found.collect())
    assert rows(config.category_dim_of(found)) == [
        ("ann", meta, "groceries", name) for meta in ("fun", "spending") for name in ("Food", "Market")
    ]
    assert rows(config.habit_targets(found)) == [("ann", "mood", 5.0), ("ann", "steps", 1.5)]
    assert rows(config.task_rollup_set(found)) == [("ann", "Home"), ("ann", "Work")]


def table(spark, *data):
    return spark.createDataFrame(list(data), "user string, x bigint")


DAY1, DAY2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)


@pytest.fixture()
def root(tmp_path):
    return str(tmp_path / "snapshots")


def test_rerun_replaces_only_its_day(spark, root):
    snapshots.write_snapshot(table(spark, ("a", 1)), root, "d", DAY1)
    snapshots.write_snapshot(table(spark, ("a", 2)), root, "d", DAY2)
    snapshots.write_snapshot(table(spark, ("a", 3)), root, "d", DAY2, cluster_by=["user"])
    assert rows(spark.read.parquet(f"{root}/d")) == [("a", 1, DAY1), ("a", 3, DAY2)]
    assert rows(snapshots.latest_snapshot(spark, root, "d")) == [("a", 3)]


def test_latest_of_a_user_missing_today(spark, root):
    snapshots.write_snapshot(table(spark, ("a", 1), ("b", 1)), root, "d", DAY1)
    snapshots.write_snapshot(table(spark, ("a", 2)), root, "d", DAY2)
    assert rows(snapshots.latest_snapshot(spark, root, "d", user="b"), "x") == [(1,)]
    assert rows(snapshots.latest_snapshot(spark, root, "d", user="a"), "x") == [(2,)]
    with pytest.raises(ValueError, match="no dated snapshot"):
        snapshots.latest_snapshot(spark, root, "d", user="c")


def test_no_snapshot_is_an_error(spark, root):
    with pytest.raises(ValueError, match="no dated snapshot"):
        snapshots.latest_snapshot(spark, root, "d")
    snapshots.write_snapshot(table(spark, ("a", 1)), root, "d", dt.date(2018, 12, 31))
    with pytest.raises(ValueError, match="no dated snapshot"):
        snapshots.latest_snapshot(spark, root, "d")


def test_hot_user_spreads_over_files(spark, root):
    big = spark.range(20000).select(F.lit("hot").alias("user"), F.col("id").alias("x"))
    with_shuffle = big.repartition(8)
    snapshots.write_snapshot(with_shuffle, root, "d", DAY1, cluster_by=["user"])
    stored = spark.read.parquet(f"{root}/d")
    assert stored.count() == 20000 and stored.select("x").distinct().count() == 20000


def _stop_at_users_list(monkeypatch):
    written = snapshots._write_day

    def stop(df, path, date):
        if f"/{snapshots.USERS_OF}/" in path:
            raise RuntimeError("stopped between the two writes")
        written(df, path, date)

    monkeypatch.setattr(snapshots, "_write_day", stop)


def test_day_stopped_between_its_writes_stays_invisible(spark, root, monkeypatch):
    snapshots.write_snapshot(table(spark, ("a", 1), ("b", 1)), root, "d", DAY1)
    _stop_at_users_list(monkeypatch)
    with pytest.raises(RuntimeError, match="between the two writes"):
        snapshots.write_snapshot(table(spark, ("a", 2), ("c", 2)), root, "d", DAY2)
    assert snapshots.snapshot_dates(spark, root, "d") == [DAY1]
    assert rows(snapshots.latest_snapshot(spark, root, "d"), "user", "x") == [("a", 1), ("b", 1)]
    assert rows(snapshots.latest_snapshot(spark, root, "d", user="a"), "x") == [(1,)]
    with pytest.raises(ValueError, match="no dated snapshot"):
        snapshots.latest_snapshot(spark, root, "d", user="c")
    assert rows(snapshots.list_snapshots(spark, root, ["d"])) == [("d", "a", DAY1), ("d", "b", DAY1)]
    monkeypatch.undo()
    snapshots.write_snapshot(table(spark, ("a", 2), ("c", 2)), root, "d", DAY2)
    assert rows(snapshots.latest_snapshot(spark, root, "d", user="c"), "x") == [(2,)]


def test_rerun_stopped_midway_hides_its_day(spark, root, monkeypatch):
    snapshots.write_snapshot(table(spark, ("a", 1)), root, "d", DAY1)
    snapshots.write_snapshot(table(spark, ("a", 2), ("b", 2)), root, "d", DAY2)
    _stop_at_users_list(monkeypatch)
    with pytest.raises(RuntimeError):
        snapshots.write_snapshot(table(spark, ("a", 3)), root, "d", DAY2)
    # The day's data changed but its list did not: the day is not seen until a rerun ends.
    assert snapshots.snapshot_dates(spark, root, "d") == [DAY1]
    assert rows(snapshots.latest_snapshot(spark, root, "d"), "x") == [(1,)]
    monkeypatch.undo()
    snapshots.write_snapshot(table(spark, ("a", 3)), root, "d", DAY2)
    assert rows(snapshots.latest_snapshot(spark, root, "d"), "x") == [(3,)]


def test_newest_day_of_a_user_over_many_days(spark, root):
    days = [DAY1 + dt.timedelta(days=k) for k in range(12)]
    for k, day in enumerate(days):
        users = [("u", k), ("rare", k)] if k in (2, 7) else [("u", k)]
        snapshots.write_snapshot(table(spark, *users), root, "d", day)
    assert rows(snapshots.latest_snapshot(spark, root, "d", user="rare"), "x") == [(7,)]
    assert rows(snapshots.latest_snapshot(spark, root, "d", user="u"), "x") == [(11,)]
    with pytest.raises(ValueError, match="no dated snapshot"):
        snapshots.latest_snapshot(spark, root, "d", user="nobody")


def listing(spark, *data):
    return spark.createDataFrame(list(data), "dataset string, user string, snapshot_date date")


def test_retention_waits_for_every_dataset_of_a_user(spark):
    before = [(d, u, DAY1) for d in ("money", "sleep") for u in ("a", "b")]
    after = before + [("money", "a", DAY2), ("sleep", "a", DAY2), ("money", "b", DAY2)]
    plan = snapshots.retention_plan(listing(spark, *before), listing(spark, *after))
    assert rows(plan) == [("money", "a", DAY1), ("sleep", "a", DAY1)]


def test_same_day_rerun_drops_nothing(spark):
    before = [("money", "a", DAY1)]
    assert snapshots.retention_plan(listing(spark, *before), listing(spark, *before)).count() == 0


def test_drop_covers_whole_days_only(spark, root):
    names = ("money", "sleep")
    for name in names:
        snapshots.write_snapshot(table(spark, ("a", 1), ("b", 1)), root, name, DAY1)
    before = spark.createDataFrame(snapshots.list_snapshots(spark, root, names).collect())
    snapshots.write_snapshot(table(spark, ("a", 2), ("b", 2)), root, "money", DAY2)
    snapshots.write_snapshot(table(spark, ("a", 2)), root, "sleep", DAY2)
    after = snapshots.list_snapshots(spark, root, names)
    plan = snapshots.retention_plan(before, after)
    assert rows(plan) == [("money", "a", DAY1), ("sleep", "a", DAY1)]
    assert snapshots.removable_dates(after, plan).count() == 0
    snapshots.write_snapshot(table(spark, ("a", 2), ("b", 2)), root, "sleep", DAY2)
    after = snapshots.list_snapshots(spark, root, names)
    plan = snapshots.retention_plan(before, after)
    assert snapshots.drop_snapshots(spark, root, snapshots.removable_dates(after, plan)) == 2
    assert snapshots.snapshot_dates(spark, root, "money") == [DAY2]


def test_pages_of_two_fetch_windows(spark):
    """Page numbers start anew with each window: the later date wins, whatever the row order."""
    from tallyspark import schemas

    def page(no, day, value):
        return ("a", no, None, [("Mood", [(day, value)])])

    pages = [page(3, "2024-01-01", "1"), page(1, "2024-02-01", "2"), page(1, "2024-02-01", "0")]
    for order in (pages, pages[::-1]):
        df = spark.createDataFrame(order, schemas.ATTRIBUTE_PAGES)
        assert rows(landed.latest_attribute_values(df), "value") == [("2",)]
