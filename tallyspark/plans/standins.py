"""Stand-ins for the canonical inputs, as projections of the star-schema tables.

The test tables have no household columns. Each input is derived from them row by
row, so it grows with them; see the SURVEY for the mapping.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed schemas of the tables read.
TABLES = {
    "customer": "c_custkey BIGINT, c_name STRING, c_acctbal DOUBLE, c_mktsegment STRING",
    "events": (
        "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE"
    ),
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
        "l_quantity DOUBLE, l_returnflag STRING, l_shipdate TIMESTAMP_NTZ"
    ),
    "orders": (
        "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
        "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"
    ),
    "part": (
        "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, "
        "p_retailprice DOUBLE"
    ),
}

# Spending name -> category, and meta category -> categories.
NAME_CATEGORY = {
    "1-URGENT": "paycheck",
    "2-HIGH": "bonus",
    "3-MEDIUM": "groceries",
    "4-NOT SPECIFIED": "housing",
    "5-LOW": "investments",
}
META_CATEGORIES = {
    "income": ("paycheck", "bonus"),
    "spending": ("groceries", "housing"),
    "saving": ("investments",),
}
# Market segment -> account type.
SEGMENT_TYPE = {
    "AUTOMOBILE": "CreditAccount",
    "BUILDING": "BankAccount",
    "FURNITURE": "CashAccount",
    "HOUSEHOLD": "InvestmentAccount",
    "MACHINERY": "LoanAccount",
}
# Weekly target per habit, label per attribute, target per attribute.
HABIT_TARGET = {"click": 50.0, "error": 60.0, "purchase": 70.0, "signup": 80.0, "view": 90.0}
ATTRIBUTE_LABEL = {
    "click": "Productive min",
    "error": "Untracked",
    "purchase": "Bedtime",
    "signup": "Wake time",
    "view": "Mood",
}
ATTRIBUTE_TARGET = {
    "mood": 50.0,
    "productive_min": 60.0,
    "sleep_end": 1.0,
    "sleep_start": 12.5,
}
AS_OF = dt.date(2024, 1, 15)
EARNED_NAMES = ("1-URGENT", "2-HIGH")
USERS = 50


def _mapped(column: str, mapping: dict) -> Column:
    result = F.lit(None)
    for key, value in mapping.items():
        result = F.when(F.col(column) == key, F.lit(value)).otherwise(result)
    return result


def literal_table(spark: SparkSession, columns: Sequence[str], rows: Iterable) -> DataFrame:
    """A small fixed table. VALUES is a local relation, whose exact size lets joins broadcast it."""
    values = ", ".join(
        "(" + ", ".join(f"{v}D" if isinstance(v, float) else f"'{v}'" for v in row) + ")"
        for row in rows
    )
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(columns)})")


class StandIns:
    """Lazily derived inputs over one directory of test tables."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        """One read per table, by its fixed schema, so no footer is opened to plan a query."""
        if name not in self._tables:
            reader = self.spark.read.schema(TABLES[name])
            self._tables[name] = reader.parquet(f"{self.directory}/{name}.parquet")
        return self._tables[name]

    @cached_property
    def transactions(self) -> DataFrame:
        cents = F.expr("cast(rint(o_totalprice * 100) as bigint) div 2000")
        sign = F.when(F.col("o_orderpriority").isin(*EARNED_NAMES), 1).otherwise(-1)
        return self.table("orders").select(
            (F.col("o_custkey") % USERS).cast("string").alias("user"),
            F.col("o_orderdate").cast("date").alias("date"),
            F.col("o_orderstatus").alias("description"),
            (cents * sign / F.lit(100.0)).alias("amount"),
            F.when(sign > 0, "credit").otherwise("debit").alias("type"),
            F.col("o_custkey").cast("string").alias("accountId"),
            F.col("o_orderpriority").alias("name"),
            F.when(F.col("o_orderstatus") == "F", "Root").otherwise("Spending").alias("parentName"),
        )

    @cached_property
    def categories(self) -> DataFrame:
        rows = [
            (meta, category, name)
            for meta, members in META_CATEGORIES.items()
            for name, category in NAME_CATEGORY.items()
            if category in members
        ]
        return literal_table(self.spark, ("meta_category", "category", "name"), rows)

    @cached_property
    def budgets(self) -> DataFrame:
        """Mean amount per user, month and name; the lowest priority arrives twice."""
        copies = F.when(F.col("name") == "5-LOW", 2).otherwise(1)
        cents = F.sum(F.rint(F.abs("amount") * 100).cast("bigint"))
        monthly = self.transactions.groupBy(
            "user", F.trunc("date", "month").alias("budgetDate"), "name"
        ).agg(cents.alias("cents"), F.count("*").alias("n"))
        return monthly.select(
            "user",
            "budgetDate",
            (F.col("cents") / F.lit(100.0)).alias("amount"),
            (F.expr("cents div n") / F.lit(100.0)).alias("budgetAmount"),
            "name",
            F.explode(F.sequence(F.lit(1), copies)).alias("copy"),
        ).drop("copy")

    @cached_property
    def accounts(self) -> DataFrame:
        return self.table("customer").select(
            (F.col("c_custkey") % USERS).cast("string").alias("user"),
            F.col("c_name").alias("name"),
            _mapped("c_mktsegment", SEGMENT_TYPE).alias("type"),
            F.when(F.col("c_acctbal") > 0, "ACTIVE").otherwise("INACTIVE").alias("systemStatus"),
            F.col("c_acctbal").alias("currentBalance"),
            F.col("c_acctbal").alias("availableBalance"),
        )

    @cached_property
    def investments(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_brand").alias("user"),
            F.col("p_name").alias("description"),
            (F.col("p_retailprice") * F.col("p_size")).alias("initialTotalCost"),
            (F.col("p_retailprice") * 2).alias("currentValue"),
            F.col("p_retailprice").alias("averagePricePaid"),
            F.col("p_retailprice").alias("currentPrice"),
            F.col("p_type").alias("symbol"),
        )

    @cached_property
    def habit_docs(self) -> DataFrame:
        """One habit document per event: a repeated time, then a trailing odd entry."""
        ms = F.unix_millis(F.col("ts").cast("timestamp")).cast("double")
        return self.table("events").select(
            F.col("user_id").cast("string").alias("user"),
            F.col("event_type").alias("id"),
            F.col("event_type").alias("title"),
            (F.col("event_type") != "error").alias("isPositive"),
            _mapped("event_type", HABIT_TARGET).alias("target"),
            F.when(F.col("event_type") == "signup", "day").otherwise("week").alias("period"),
            F.array(
                ms, F.col("value") * 2, ms, F.col("value"), ms + 3600000, F.col("value"), ms + 1
            ).alias("history"),
        )

    @cached_property
    def attributes(self) -> DataFrame:
        """One value per event; values under 1 are missing."""
        return self.table("events").select(
            F.col("user_id").cast("string").alias("user"),
            F.col("ts").cast("date").alias("date"),
            F.when(F.col("value") >= 1, F.col("value").cast("string")).alias("value"),
            _mapped("event_type", ATTRIBUTE_LABEL).alias("attribute"),
        )

    @cached_property
    def attribute_targets(self) -> DataFrame:
        return literal_table(self.spark, ("attribute", "target"), ATTRIBUTE_TARGET.items())

    @cached_property
    def attribute_pages(self) -> DataFrame:
        """A page per event: its attribute with one or two values, then an empty attribute."""
        value = F.struct(
            F.col("ts").cast("date").cast("string").alias("date"),
            F.col("value").cast("string").alias("value"),
        )
        values = F.when(F.col("value") >= 10, F.array(value, value)).otherwise(F.array(value))
        none = F.filter(values, lambda v: F.lit(False))
        return self.table("events").select(
            F.col("user_id").cast("string").alias("user"),
            F.col("event_id").alias("page_no"),
            F.array(
                F.struct(
                    _mapped("event_type", ATTRIBUTE_LABEL).alias("label"), values.alias("values")
                ),
                F.struct(F.lit("Unused").alias("label"), none.alias("values")),
            ).alias("results"),
            F.lit(None).cast("string").alias("next"),
        )

    @cached_property
    def sleep_records(self) -> DataFrame:
        seconds = F.rint(F.col("value") * 60).cast("bigint")
        start = F.col("ts").cast("timestamp_ntz")
        end = F.timestamp_add("SECOND", seconds, start)
        return self.table("events").select(
            F.col("user_id").cast("string").alias("user"),
            start.cast("timestamp").alias("sleep_start"),
            end.cast("timestamp").alias("sleep_end"),
            start.alias("start_wall"),
            end.alias("end_wall"),
        )

    @cached_property
    def _tree(self) -> DataFrame:
        """Decimal tree of part keys, shared by all users: 137 lies under 13, under 1, under root.

        Part 0 stands for the root itself.
        """
        parent = F.expr("p_partkey div 10")
        return (
            self.table("part")
            .where(F.col("p_partkey") != 0)
            .select(
                F.col("p_partkey").cast("string").alias("_id"),
                F.when(parent == 0, "root").otherwise(parent.cast("string")).alias("parentId"),
                F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("title"),
                "p_size",
            )
        )

    @property
    def task_categories(self) -> DataFrame:
        return self._tree.select("_id", "parentId", "title")

    @property
    def task_rollup(self) -> DataFrame:
        """The top-level categories of a large size."""
        top = (F.col("parentId") == "root") & (F.col("p_size") >= 25)
        return self._tree.where(top).select(F.col("title").alias("category"))

    @cached_property
    def task_docs(self) -> DataFrame:
        line = F.col("l_linenumber")
        ms = F.unix_millis(F.col("l_shipdate").cast("timestamp"))
        duration = (F.col("l_quantity") * 3600000).cast("bigint")
        times = (
            F.when(line == 1, F.lit(None).cast("array<bigint>"))
            .when(line == 2, F.array().cast("array<bigint>"))
            .otherwise(F.array(ms, ms + duration))
        )
        return self.table("lineitem").withColumn("duration_ms", duration).select(
            (F.col("l_suppkey") % USERS).cast("string").alias("user"),
            F.concat_ws("-", F.col("l_orderkey").cast("string"), line.cast("string")).alias(
                "title"
            ),
            F.when(F.col("l_returnflag") == "R", "unassigned")
            .otherwise(F.col("l_shipdate").cast("date").cast("string"))
            .alias("day"),
            F.col("l_partkey").cast("string").alias("parentId"),
            times.alias("times"),
            F.col("duration_ms").alias("duration"),
            F.when(line != 3, F.expr("duration_ms div 2")).alias("timeEstimate"),
        )
