"""Registered queries: each operator over the whole of the given tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark import functions as X
from tallyspark.operators import (
    attributes,
    forward,
    habits,
    ledger,
    scorecard,
    sleep,
    spending,
    tasks,
)
from tallyspark.operators.periods import Period, period_filter
from tallyspark.plans.standins import AS_OF, StandIns
from tallyspark.plans.views import scored_from_raw
from tallyspark.sources import config, landed, snapshots
from tallyspark.sources.workspace import settle, work_path

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

# Parameters of the money queries; the SQL counterparts state the same values.
MONTH = Period("month", 1997, month=5)
QUARTER = Period("quarter", 1997, month=5)
YEAR = Period("year", 1997)
WEEK_AS_MONTH = Period("week", 1997, month=5, week=20)
START_YEAR = 1997
PROFIT_TARGET = 100.0
HOUSING = -150.0
RUNNING_MONTH = dt.date(2001, 7, 15)
INCOME = ("paycheck",)
NOT_SPENDING = ("paycheck", "bonus")
IRREGULAR = ("bonus", "investments")

# Parameters of the tracker queries.
WEEK_2 = Period("week", 2024, week=2)
JANUARY = Period("month", 2024, month=1)
FIRST_QUARTER = Period("quarter", 2024, month=2)
WHOLE_YEAR = Period("year", 2024)


def query(build: Callable[[StandIns], DataFrame]) -> Callable[[StandIns], DataFrame]:
    """Register a query under the function's name."""

    def run(spark: SparkSession, directory: str) -> DataFrame:
        return present(build(StandIns(spark, directory)))

    _QUERIES[build.__name__] = run
    return build


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def present(df: DataFrame) -> DataFrame:
    """Plain output types: whole numbers as BIGINT, decimals as DOUBLE, dates and timestamps as text."""

    def plain(field: T.StructField) -> Column:
        column, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            column = column.cast("bigint")
        elif isinstance(kind, T.DecimalType):
            column = column.cast("double")
        elif isinstance(kind, T.DateType):
            column = column.cast("string")
        elif isinstance(kind, T.TimestampType):
            utc = F.to_utc_timestamp(column, F.current_timezone())
            column = F.date_format(utc, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(kind, T.TimestampNTZType):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        return column.alias(field.name)

    return df.select(*[plain(f) for f in df.schema.fields])


# --- inputs -----------------------------------------------------------------


def _landed(df: DataFrame, name: str) -> str:
    path = work_path(df.sparkSession, name)
    df.write.json(path)
    return path


@query
def read_accounts(s):
    return landed.read_accounts(s.spark, _landed(s.accounts, "accounts"))


def _nested(df: DataFrame, *fields: str) -> DataFrame:
    return df.withColumn("category", F.struct(*fields)).drop(*fields)


@query
def read_transactions(s):
    docs = _nested(s.transactions, "name", "parentName")
    return landed.read_transactions(s.spark, _landed(docs, "transactions"))


@query
def read_investments(s):
    return landed.read_investments(s.spark, _landed(s.investments, "investments"))


@query
def read_budgets(s):
    return landed.read_budgets(s.spark, _landed(_nested(s.budgets, "name"), "budgets"))


@query
def select_docs(s):
    """Three document kinds landed in one dataset, one of them read back."""
    docs = (
        s.task_docs.withColumn("db", F.lit("Tasks"))
        .unionByName(
            s.task_categories.withColumn("db", F.lit("Categories")), allowMissingColumns=True
        )
        .unionByName(s.habit_docs.withColumn("db", F.lit("Habits")), allowMissingColumns=True)
    )
    path = work_path(s.spark, "docs")
    docs.write.partitionBy("db").json(path)
    return landed.select_docs(landed.read_docs(s.spark, path), "Categories").select(
        "_id", "parentId", "title"
    )


@query
def read_attributes(s):
    pages = landed.read_attribute_pages(s.spark, _landed(s.attribute_pages, "pages"))
    return landed.read_attributes(pages).withColumn("value", F.col("value").cast("double"))


@query
def latest_attribute_values(s):
    pages = landed.read_attribute_pages(s.spark, _landed(s.attribute_pages, "pages"))
    return landed.latest_attribute_values(pages).withColumn(
        "value", F.col("value").cast("double")
    )


@query
def read_sleep_xml(s):
    """Sleep records and others, exported as XML attributes and read back."""
    pattern = "yyyy-MM-dd HH:mm:ss"
    end = F.col("ts") + F.expr("INTERVAL 90 MINUTES")
    records = s.table("events").select(
        F.when(F.col("event_type") == "click", "HKQuantityTypeIdentifierStepCount")
        .otherwise(landed.SLEEP_RECORD)
        .alias("_type"),
        F.concat(F.date_format("ts", pattern), F.lit(" +0000")).alias("_startDate"),
        F.concat(F.date_format(end, pattern), F.lit(" +0000")).alias("_endDate"),
    )
    path = work_path(s.spark, "health-export")
    records.write.format("xml").option("rootTag", "HealthData").option("rowTag", "Record").save(
        path
    )
    return landed.read_sleep_xml(s.spark, path, user="owner")


@query
def month_calendar(s):
    spans = s.transactions.groupBy("user").agg(
        F.min(F.trunc("date", "month")).alias("start"), F.max("date").alias("end")
    )
    return landed.month_calendar(spans, "start", "end")


def _config(s: StandIns) -> DataFrame:
    """One configuration document per part type, with brands as names."""
    part = s.table("part")
    docs = part.groupBy(F.col("p_type").alias("category")).agg(
        F.collect_set("p_brand").alias("names"), F.max("p_retailprice").alias("target")
    )
    rows = docs.select(
        F.lit("owner").alias("user"),
        F.create_map("category", F.concat("names", F.array(F.lit(None)))).alias(
            "aggregate_categories"
        ),
        F.create_map(F.lower("category"), F.array("category")).alias("meta_categories"),
        F.struct(F.create_map("category", "target").alias("key_habits")).alias("attribute_config"),
        F.struct(F.array("category").alias("aggregate_categories")).alias("task_config"),
    )
    return config.read_config(s.spark, _landed(rows, "config"), multi_line=False)


@query
def config_dims(s):
    return config.category_dim_of(_config(s))


@query
def habit_targets(s):
    return config.habit_targets(_config(s))


@query
def task_rollup_set(s):
    return config.task_rollup_set(_config(s))


@query
def write_snapshot(s):
    """Two days, the first written twice: the rerun replaces its own day only."""
    root = work_path(s.spark, "snapshots")
    totals = ledger.account_totals(s.accounts)
    first, second = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    snapshots.write_snapshot(s.accounts.select("user"), root, "account_totals", first)
    snapshots.write_snapshot(totals, root, "account_totals", first, cluster_by=["user"])
    snapshots.write_snapshot(totals, root, "account_totals", second)
    return s.spark.read.parquet(f"{root}/account_totals")


@query
def latest_snapshot(s):
    root = work_path(s.spark, "snapshots")
    old = ledger.account_totals(s.accounts, credit_apart=True)
    snapshots.write_snapshot(old, root, "account_totals", dt.date(2024, 1, 1))
    new = ledger.account_totals(s.accounts)
    snapshots.write_snapshot(new, root, "account_totals", dt.date(2024, 1, 2))
    return snapshots.latest_snapshot(s.spark, root, "account_totals")


@query
def latest_snapshot_of_user(s):
    """A user whose accounts are missing on the newest day is served from the day before."""
    root = work_path(s.spark, "snapshots")
    totals = ledger.account_totals(s.accounts)
    snapshots.write_snapshot(totals, root, "account_totals", dt.date(2024, 1, 1), ["user"])
    others = totals.where(F.col("user") != "7")
    snapshots.write_snapshot(others, root, "account_totals", dt.date(2024, 1, 2), ["user"])
    return snapshots.latest_snapshot(s.spark, root, "account_totals", user="7")


@query
def retention_plan(s):
    """Budgets refreshed for all, accounts only for users with a large active balance."""
    root = work_path(s.spark, "snapshots")
    names = ("monthly_budget", "account_totals")
    first, second = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    budget = ledger.monthly_budget(s.budgets, s.categories)
    totals = ledger.account_totals(s.accounts)
    snapshots.write_snapshot(budget, root, "monthly_budget", first)
    snapshots.write_snapshot(totals, root, "account_totals", first)
    before = settle(snapshots.list_snapshots(s.spark, root, names), "listing")
    rich = totals.groupBy("user").agg(X.exact_sum("total").alias("t")).where("t > 100000")
    snapshots.write_snapshot(budget, root, "monthly_budget", second)
    snapshots.write_snapshot(
        totals.join(rich, "user", "left_semi"), root, "account_totals", second
    )
    return snapshots.retention_plan(before, snapshots.list_snapshots(s.spark, root, names))


@query
def all_users(s):
    """Each order status plays a user: one read of a table with all of them, grouped by user."""
    owned = s.transactions.withColumn("user", F.col("description"))
    return ledger.daily_finances(owned, s.categories)


# --- ledger -----------------------------------------------------------------


def _daily(s: StandIns) -> DataFrame:
    return ledger.daily_finances(s.transactions, s.categories)


def _budget(s: StandIns) -> DataFrame:
    return ledger.monthly_budget(s.budgets, s.categories)


@query
def root_parent_fill(s):
    return (
        ledger.root_parent_fill(s.transactions)
        .groupBy("user", "parentName")
        .agg(F.count("*").alias("n"))
    )


@query
def classify_accounts(s):
    return ledger.classify_accounts(s.accounts).select("user", "name", "type", "account_type")


@query
def category_dim(s):
    meta = s.categories.select("meta_category", "category").distinct()
    dim = ledger.category_dim(meta, s.categories.select("category", "name"), keys=())
    return (
        s.transactions.join(dim, "name")
        .groupBy("user", "meta_category")
        .agg(F.count("*").alias("n"), X.exact_sum("amount").alias("total"))
    )


@query
def daily_finances(s):
    return _daily(s)


@query
def current_budgets(s):
    return ledger.current_budgets(s.budgets)


@query
def monthly_budget(s):
    return _budget(s)


@query
def account_totals(s):
    return ledger.account_totals(s.accounts)


@query
def budget_by_user(s):
    return ledger.budget_by_user(_budget(s))


# --- periods and predicates ---------------------------------------------------


@query
def period_week(s):
    return period_filter(habits.habit_week(habits.habit_history(s.habit_docs)), WEEK_2)


@query
def period_iso_week(s):
    """The first ISO week of a year, which starts in the December before."""
    return period_filter(_daily(s), Period("iso_week", 1997, week=1), "timestamp")


@query
def period_month(s):
    return period_filter(_daily(s), MONTH, "timestamp")


@query
def period_quarter(s):
    return period_filter(_daily(s), QUARTER, "timestamp")


@query
def period_year(s):
    return period_filter(_daily(s), YEAR, "timestamp")


@query
def category_not_in(s):
    """Null-safe exclusion: transactions of unmapped names stay."""
    dim = s.categories.where(F.col("category") != "housing").select("name", "category")
    rows = s.transactions.join(dim, "name", "left")
    return (
        rows.where(X.not_in("category", ["bonus", "investments"]))
        .groupBy("user", "category")
        .agg(F.count("*").alias("n"))
    )


# --- spending -----------------------------------------------------------------


@query
def month_sum(s):
    return spending.month_sum(_daily(s), IRREGULAR)


def _spend(s: StandIns, period: Period) -> DataFrame:
    return spending.spend_vs_budget(_daily(s), _budget(s), period)


@query
def spend_vs_budget_week(s):
    return _spend(s, WEEK_AS_MONTH)


@query
def spend_vs_budget_month(s):
    return _spend(s, MONTH)


@query
def spend_vs_budget_quarter(s):
    return _spend(s, QUARTER)


@query
def spend_vs_budget_year(s):
    return _spend(s, YEAR)


@query
def budget_variance(s):
    return spending.budget_variance(_spend(s, YEAR))


@query
def spend_budget_long(s):
    return spending.spend_budget_long(_spend(s, QUARTER))


@query
def monthly_income(s):
    return spending.monthly_income(_daily(s), 1997, 5, INCOME, users=s.accounts.select("user"))


@query
def budget_shortfall(s):
    return spending.budget_shortfall(
        _daily(s), PROFIT_TARGET, 1999, 5, START_YEAR, INCOME, NOT_SPENDING
    )


@query
def avg_monthly_by_category(s):
    return spending.avg_monthly_by_category(_daily(s), START_YEAR)


@query
def avg_past_months_by_category(s):
    return spending.avg_monthly_by_category(_daily(s), START_YEAR, RUNNING_MONTH)


@query
def saving_mix(s):
    return spending.saving_mix(
        _daily(s), HOUSING, START_YEAR, RUNNING_MONTH, irregular=IRREGULAR, income=INCOME
    )


@query
def account_pivot(s):
    return spending.account_pivot(ledger.account_totals(s.accounts))


def _kpis(s: StandIns, period: Period) -> DataFrame:
    return spending.account_kpis(
        ledger.account_totals(s.accounts), _budget(s), _daily(s), period
    )


@query
def account_kpis(s):
    return _kpis(s, MONTH)


@query
def account_kpis_year(s):
    return _kpis(s, YEAR)


@query
def account_kpis_v1(s):
    return spending.account_outlook(
        ledger.account_totals(s.accounts, credit_apart=True),
        _daily(s),
        HOUSING,
        6,
        START_YEAR,
        income="paycheck",
    )


@query
def savings_series(s):
    return spending.savings_series(
        _daily(s), PROFIT_TARGET, START_YEAR, INCOME, NOT_SPENDING, IRREGULAR
    )


@query
def spending_series(s):
    return spending.spending_series(_daily(s), PROFIT_TARGET, START_YEAR, INCOME, NOT_SPENDING)


@query
def quarterly_profit_loss(s):
    return spending.quarterly_profit_loss(_daily(s))


@query
def forward_stats(s):
    return forward.forward_stats(spending.month_sum(_daily(s), ("bonus",)), "profit")


@query
def forward_budget(s):
    return forward.forward_budget(_daily(s), START_YEAR)


# --- habits, attributes, sleep, scorecard ---------------------------------------


@query
def habit_history(s):
    return habits.habit_history(s.habit_docs)


@query
def habit_week(s):
    return habits.habit_week(habits.habit_history(s.habit_docs))


def _attributes(s: StandIns) -> DataFrame:
    return attributes.format_attributes(s.attributes, s.attribute_targets, AS_OF)


@query
def format_attributes(s):
    return _attributes(s).withColumn("value", F.round("value", 6))


@query
def weekly_rating(s):
    return attributes.weekly_rating(_attributes(s))


@query
def habit_achievement(s):
    return attributes.habit_achievement(_attributes(s), 2024, 1, dt.date(2024, 3, 10))


@query
def habit_achievement_running(s):
    return attributes.habit_achievement(_attributes(s), 2024, 1, AS_OF)


def _sleep(s: StandIns) -> DataFrame:
    return sleep.format_sleep(sleep.sleep_nights(s.sleep_records))


@query
def sleep_nights(s):
    return sleep.sleep_nights(s.sleep_records)


@query
def format_sleep(s):
    return _sleep(s)


@query
def avg_time_of_day(s):
    return sleep.avg_time_of_day(_sleep(s))


@query
def avg_duration(s):
    return sleep.avg_duration(_sleep(s))


@query
def avg_sleep(s):
    return sleep.avg_sleep(_sleep(s))


def _scored(s: StandIns, period: Period | None = None) -> DataFrame:
    return scored_from_raw(
        s.habit_docs, s.attributes, s.attribute_targets, s.sleep_records, AS_OF, period=period
    )


def _base(s: StandIns, period: Period) -> DataFrame:
    return scorecard.scorecard_base(_scored(s, period), period)


def _card(df: DataFrame) -> DataFrame:
    """Seconds are missing for habits and ratings; a nullable number travels as DOUBLE."""
    seconds = ("tod_seconds", "target_seconds")
    return df.withColumns({c: F.col(c).cast("double") for c in seconds})


@query
def scored_rows(s):
    return _card(_scored(s))


@query
def distinct_weeks(s):
    return scorecard.distinct_weeks(_scored(s))


@query
def scorecard_base(s):
    return _card(_base(s, JANUARY))


@query
def scorecard_week(s):
    return _card(_base(s, WEEK_2))


@query
def scorecard_quarter(s):
    return _card(_base(s, FIRST_QUARTER))


@query
def scorecard_year(s):
    return _card(_base(s, WHOLE_YEAR))


@query
def scorecard_success(s):
    return _card(scorecard.scorecard_success(_base(s, WEEK_2)))


@query
def scorecard_fail(s):
    return _card(scorecard.scorecard_fail(_base(s, WEEK_2)))


@query
def supporting_table(s):
    return scorecard.supporting_table(_base(s, WEEK_2))


# --- tasks ------------------------------------------------------------------------


@query
def task_duration(s):
    return tasks.task_duration(s.task_docs).select(
        "user", "title", "start_time", "end_time", "duration"
    )


@query
def category_path(s):
    return tasks.category_paths(s.task_categories)


def _tasks(s: StandIns) -> DataFrame:
    return tasks.tasks(s.task_docs, tasks.category_paths(s.task_categories))


@query
def task_table(s):
    return _tasks(s).drop("duration_ms")


@query
def format_tasks(s):
    return tasks.format_tasks(_tasks(s), s.task_rollup).drop("duration_ms")


@query
def task_time_by_category(s):
    return tasks.task_time_by_category(
        tasks.format_tasks(_tasks(s), s.task_rollup), 1998, 7, min_hours=40
    )


# --- scalar functions ----------------------------------------------------------------


@query
def date_functions(s):
    day = F.col("o_orderdate").cast("date")
    return s.table("orders").select(
        "o_orderkey",
        *X.date_parts(day, "year", "month", "day"),
        F.quarter(day).alias("quarter"),
        X.iso_week(day).alias("iso_week"),
        X.month_start(F.year(day), F.month(day)).alias("month_start"),
        X.days_in_month(day).alias("days_in_month"),
        F.date_diff(F.lit(dt.date(2002, 1, 1)), day).alias("age_days"),
    )


@query
def clock_functions(s):
    seconds = X.seconds_of_day(F.col("ts"))
    return s.table("events").select(
        "event_id",
        F.hour("ts").alias("hour"),
        seconds.alias("seconds"),
        X.floor_minute(seconds).alias("minute_seconds"),
        X.clock_text(seconds).alias("clock_24"),
        X.clock_text(seconds, twelve_hour=True, suffix=True).alias("clock_12"),
        X.clock_text(seconds, twelve_hour=True).alias("clock_12_bare"),
        X.millis_to_date(F.unix_millis(F.col("ts").cast("timestamp"))).alias("local_date"),
    )


@query
def rounding_functions(s):
    return s.table("customer").select(
        "c_custkey",
        X.half_even(F.col("c_custkey") * 5.0, -1).alias("tens"),
        X.half_even(F.col("c_custkey") / F.lit(8.0), 2).alias("hundredths"),
        X.money_text(X.half_even(F.col("c_acctbal"), -1)).alias("money"),
        F.abs("c_acctbal").alias("magnitude"),
    )


@query
def text_functions(s):
    title = F.concat_ws("/", "p_type", "p_brand", "p_name")
    return s.table("part").select(
        "p_partkey",
        F.lower(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("normalised"),
        F.split(title, "/")[0].alias("nearest"),
        F.element_at(F.split(title, "/"), -1).alias("topmost"),
    )
