"""Readers of the landed JSON and XML inputs, one row per user record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark import schemas

KEYS = ("user",)

# The record type of sleep fragments and the export's time pattern.
SLEEP_RECORD = "HKCategoryTypeIdentifierSleepAnalysis"
EXPORT_TIME = "yyyy-MM-dd HH:mm:ss Z"
WALL_CLOCK_CHARS = 19

# Fixed value: mean length of a month in days, 365.2425 / 12.
MONTH_DAYS = 30.436875


def read_accounts(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.schema(schemas.ACCOUNTS)
        .json(path)
        .select("user", "name", "type", "systemStatus", "currentBalance", "availableBalance")
    )


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.schema(schemas.TRANSACTIONS)
        .json(path)
        .select(
            "user",
            "date",
            "description",
            "amount",
            "type",
            "accountId",
            "category.name",
            "category.parentName",
        )
    )


def read_investments(spark: SparkSession, path: str) -> DataFrame:
    """Documents may carry more fields, such as a symbol; only the common ones are read."""
    return (
        spark.read.schema(schemas.INVESTMENTS)
        .json(path)
        .select(
            "user",
            "description",
            "initialTotalCost",
            "currentValue",
            "averagePricePaid",
            "currentPrice",
        )
    )


def read_budgets(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.schema(schemas.BUDGETS)
        .json(path)
        .select("user", "budgetDate", "amount", "budgetAmount", "category.name")
    )


def read_docs(spark: SparkSession, path: str) -> DataFrame:
    """Task tracker documents. Landed under ``db=...`` folders, a kind prunes to its folder."""
    return spark.read.schema(schemas.DOCS).json(path)


def select_docs(docs: DataFrame, kind: str) -> DataFrame:
    """Documents of one kind: Categories, Tasks or Habits."""
    return docs.where(F.col("db") == kind)


def read_attribute_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.ATTRIBUTE_PAGES).json(path)


def read_attributes(pages: DataFrame) -> DataFrame:
    """One row per attribute value of every page; attributes without values vanish.

    Dates and values leave typed, so that a period reaches the scan of a snapshot of them;
    what cannot be read is NULL.
    """
    return (
        pages.select("user", F.inline("results"))
        .select("user", F.inline("values"), F.col("label").alias("attribute"))
        .withColumns({"date": F.col("date").try_cast("date"), "value": F.col("value").try_cast("double")})
    )


def latest_attribute_values(pages: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """First value of each attribute on its newest page.

    Newest is by the value's date, then the page number, which starts anew with each fetch
    window, then the place on the page; of equals the greater value. The order is a struct
    of the three, uncapped: any page number or place keeps its rank. Spark orders null fields
    first, so a value whose date cannot be read loses to any readable one, and a NULL page
    number to any page. Only the order and the group travel to the maximum; the winners'
    texts follow by a semi-join on it.
    """
    first = F.get("values", F.lit(0))
    order = F.struct(
        F.unix_date(first["date"].try_cast("date")).alias("day"),
        F.col("page_no").alias("page"),
        F.col("place"),
    )
    found = (
        pages.select(*keys, "page_no", F.posexplode("results").alias("place", "result"))
        .select(*keys, "page_no", "place", F.col("result.label").alias("attribute"), "result.values")
        .where(F.size("values") > 0)
        .select(*keys, "attribute", first["value"].alias("value"), order.alias("rank"))
    )
    group = [*keys, "attribute"]
    newest = found.groupBy(*group).agg(F.max("rank").alias("rank"))
    winners = found.join(newest, [*group, "rank"], "left_semi")
    return winners.groupBy(*group).agg(F.max("value").alias("value"))


def sleep_times(start: str, end: str) -> list:
    """Instant and wall clock of both ends of a record."""

    def instant(text: str):
        return F.try_to_timestamp(text, F.lit(EXPORT_TIME))

    def wall(text: str):
        return F.substring(text, 1, WALL_CLOCK_CHARS).try_cast("timestamp_ntz")

    return [
        instant(start).alias("sleep_start"),
        instant(end).alias("sleep_end"),
        wall(start).alias("start_wall"),
        wall(end).alias("end_wall"),
    ]


def read_sleep_xml(spark: SparkSession, path: str, user: str | None = None) -> DataFrame:
    """Sleep fragments of health exports.

    Exports hold one user each; the user is the given one or, for a folder of
    exports, the file name without its extension.
    """
    owner = F.lit(user) if user else F.regexp_extract("_metadata.file_name", r"^([^.]*)", 1)
    return (
        spark.read.format("xml")
        .option("rowTag", "Record")
        .schema(schemas.SLEEP_XML)
        .load(path)
        .where(F.col("_type") == SLEEP_RECORD)
        .select(owner.alias("user"), *sleep_times("_startDate", "_endDate"))
    )


def month_calendar(spans: DataFrame, start: str, end: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Month ends and day counts between two dates of each row: the fetch windows.

    The number of months is the span in mean months, rounded up.
    """
    months = F.ceil(F.date_diff(end, start) / F.lit(MONTH_DAYS)).cast("int")
    month_end = F.last_day(F.add_months(start, F.col("n")))
    return (
        spans.where(months > 0)
        .select("*", F.explode(F.sequence(F.lit(0), months - 1)).alias("n"))
        .select(
            *keys,
            month_end.alias("month_end"),
            F.dayofmonth(month_end).cast("bigint").alias("days"),
        )
    )

