"""What the physical plans must and must not contain."""

import re

import pytest

from tallyspark import Period
from tallyspark.operators import forward, ledger, scorecard, sleep, spending, tasks
from tallyspark.plans.catalogue import queries
from tallyspark.plans.standins import AS_OF, StandIns
from tallyspark.plans.views import scored_from_raw

SF = "/root/testdata/sf0.001"
YEAR = Period("year", 1997)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def s(spark):
    return StandIns(spark, SF)


@pytest.fixture(scope="module")
def daily(s):
    return ledger.daily_finances(s.transactions, s.categories)


@pytest.fixture(scope="module")
def budget(s):
    return ledger.monthly_budget(s.budgets, s.categories)


@pytest.mark.parametrize("name", sorted(queries()))
def test_no_python_and_no_cross_join(spark, name):
    text = plan(queries()[name](spark, SF))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEval", "BatchEvalPython", "InPandas"):
        assert operator not in text


def test_period_reaches_the_scan(daily, budget):
    text = plan(spending.spend_vs_budget(daily, budget, YEAR))
    pushed = re.search(r"o_orderdate[^\n]*PushedFilters: \[([^\]]*)\]", text).group(1)
    assert "GreaterThanOrEqual(o_orderdate,1997-01-01" in pushed
    assert "LessThan(o_orderdate,1998-01-01" in pushed


def test_start_year_reaches_the_scan(daily):
    pushed = re.search(r"PushedFilters: \[([^\]]*)\]", plan(forward.forward_budget(daily, 1999)))
    assert "GreaterThanOrEqual(o_orderdate,1999-01-01" in pushed.group(1)


def test_scorecard_period_reaches_the_scan(s):
    period = Period("week", 2024, week=2)
    rows = scored_from_raw(
        s.habit_docs, s.attributes, s.attribute_targets, s.sleep_records, AS_OF, period=period
    )
    text = plan(scorecard.scorecard_base(rows, period))
    assert "GreaterThanOrEqual(ts,2024-01-08" in text and "LessThan(ts,2024-01-15" in text


def test_only_needed_columns_are_read(daily):
    read = re.findall(r"ReadSchema: struct<([^>]*)", plan(spending.month_sum(daily)))
    assert len(read) == 1 and "o_orderkey" not in read[0] and "o_orderstatus" not in read[0]


def shuffles(df):
    return len(re.findall(r"Exchange hashpartitioning", plan(df)))


def scans(df):
    return len(re.findall(r"Scan parquet", plan(df)))


def test_daily_rows_shuffle_once(daily):
    # One for the distinct category mapping, one for the raw rows, one for what they reduce to.
    assert shuffles(daily) == 3
    assert scans(daily) == 1


@pytest.mark.parametrize(
    "build",
    [
        lambda f: forward.forward_budget(f, 1997),
        lambda f: spending.saving_mix(f, -150.0, 1997, AS_OF),
        lambda f: spending.savings_series(f, 100, 1997),
        lambda f: spending.spending_series(f, 100, 1997),
        lambda f: spending.budget_shortfall(f, 100, 1999, 5, 1997),
    ],
)
def test_multi_series_queries_read_the_ledger_once(daily, build):
    assert scans(build(daily)) == 1


def test_scorecard_reads_each_source_once(s):
    rows = scored_from_raw(s.habit_docs, s.attributes, s.attribute_targets, s.sleep_records, AS_OF)
    card = scorecard.scorecard_base(rows, Period("month", 2024, month=1))
    assert scans(card) == 3
    # Habits, rating and nights each once; then the card and the window over it.
    assert shuffles(card) == 5


def test_averages_stay_in_hash_aggregation(s):
    text = plan(sleep.avg_sleep(sleep.format_sleep(sleep.sleep_nights(s.sleep_records))))
    assert "SortAggregate" not in text and "ObjectHashAggregate" not in text


def test_windows_see_reduced_rows(daily):
    text = plan(spending.savings_series(daily, 100, 1997))
    below = text[text.rindex("Window") :]
    assert "HashAggregate" in below.split("Scan parquet")[0]


def test_large_sides_fall_back_to_shuffled_joins(spark, s):
    """Nothing forces a broadcast: beyond the threshold every join shuffles both sides."""
    paths = tasks.category_paths(s.task_categories)
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (tasks.tasks(s.task_docs, paths), ledger.daily_finances(s.transactions, s.categories)):
            text = plan(df)
            assert "SortMergeJoin" in text and "Broadcast" not in text
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)


def test_hot_parent_is_split_by_the_adaptive_join(spark, s):
    """A third of all tasks under one category: AQE splits that partition of the join."""
    from pyspark.sql import functions as F

    hot = F.when(F.col("title").endswith("1"), "11").otherwise(F.col("parentId"))
    docs = s.task_docs.repartition(8).withColumn("parentId", hot)
    paths = tasks.category_paths(s.task_categories)
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
    }
    expected = tasks.tasks(docs, paths).count()
    keep = {k: spark.conf.get(k, None) for k in small}
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        joined = tasks.tasks(docs, paths)
        found = joined.collect()
        text = plan(joined)
    finally:
        for key, value in keep.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert len(found) == expected
    assert "SortMergeJoin(skew=true)" in text or "skew" in text.split("Initial Plan")[0]
