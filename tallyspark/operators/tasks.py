"""Task durations and their place in a category tree of any depth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import as_date, date_parts, millis_to_date, not_in, shared_keys
from tallyspark.operators.periods import Period, period_filter
from tallyspark.sources.workspace import settle

KEYS = ("user",)
ROOT = "root"
HOUR_MS = 3_600_000


def task_duration(tasks: DataFrame) -> DataFrame:
    """Add ``start_time``, ``end_time`` and ``duration`` in hours; all NULL without ``times``.

    ``duration_ms`` keeps the landed whole milliseconds, which add up exactly.

    A single entry in ``times`` leaves the end unknown.
    """
    tracked = F.col("times").isNotNull()
    return tasks.withColumns(
        {
            "start_time": millis_to_date(F.get("times", F.lit(0))),
            "end_time": millis_to_date(F.get("times", F.lit(1))),
            "duration_ms": F.when(tracked, F.col("duration")),
            "duration": F.when(tracked, F.col("duration") / HOUR_MS),
        }
    )


def _nodes(categories: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per category id; of duplicates the first by title."""
    return (
        categories.where(F.col("_id").isNotNull())
        .groupBy(*keys, "_id")
        .agg(F.min(F.struct("title", "parentId")).alias("doc"))
        .select(*keys, F.col("_id").alias("node"), "doc.title", "doc.parentId")
    )


def category_paths(categories: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Path from each category up to the root, nearest title first, and the topmost title.

    Works on the category table alone, never on tasks, and runs jobs while the plan is built:
    every open chain is joined to the chain its far end starts, so the depth covered doubles
    per round. A chain ends at ``root``, whether or not a document has that id. Chains whose
    parent is missing fall out of the inner join; a round that closes no chain leaves only
    cycles.

    Each round is written to the shared work folder, which cuts the lineage, survives lost
    executors and tells the join with the tasks the size of the paths; the round before it is
    removed then.
    """
    shared = shared_keys(categories, keys)
    chains = settle(
        _nodes(categories, shared).select(
            *shared,
            "node",
            F.col("parentId").alias("end"),
            F.col("title").alias("path"),
            F.col("title").alias("category"),
        ),
        "category-chains",
    )
    is_closed = F.col("end") == ROOT
    closed_before = -1
    while True:
        closed_now, open_now = chains.agg(F.count_if(is_closed), F.count_if(~is_closed)).first()
        if open_now == 0 or closed_now == closed_before:
            break
        closed_before = closed_now
        step = chains.select(
            *shared,
            F.col("node").alias("end"),
            F.col("end").alias("next_end"),
            F.col("path").alias("next_path"),
            F.col("category").alias("next_category"),
        )
        longer = (
            chains.where(~is_closed)
            .join(step, [*shared, "end"])
            .select(
                *shared,
                "node",
                F.col("next_end").alias("end"),
                F.concat("path", F.lit("/"), "next_path").alias("path"),
                F.col("next_category").alias("category"),
            )
        )
        both = chains.where(is_closed).unionByName(longer)
        chains = settle(both, "category-chains", replaces=chains)
    return chains.where(is_closed).select(*shared, "node", "path", "category")


def unresolved_categories(
    categories: DataFrame, paths: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Categories whose chain is broken or circular; tasks under them are left out."""
    on = [*shared_keys(categories, keys), "_id"]
    return categories.join(paths.withColumnRenamed("node", "_id"), on, "left_anti")


def tasks(task_docs: DataFrame, paths: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Assigned tasks with hours, dates, category path and topmost category."""
    on = [*shared_keys(paths, keys), "parentId"]
    placed = task_docs.where(not_in("day", ["unassigned"])).join(
        paths.withColumnRenamed("node", "parentId"), on
    )
    return task_duration(placed).select(
        *keys,
        F.col("title").alias("name"),
        as_date(placed, "day").alias("day"),
        (F.col("timeEstimate") / HOUR_MS).alias("time_estimate"),
        F.col("path").alias("parent"),
        "category",
        "start_time",
        "end_time",
        "duration_ms",
        "duration",
    )


def format_tasks(
    task_table: DataFrame, rollup: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Date parts, and the category shown: topmost if in the rollup set, else the nearest."""
    on = [*shared_keys(rollup, keys), "category"]
    in_set = rollup.select(*on).distinct().withColumn("in_set", F.lit(True))
    shown = F.when(F.col("in_set"), F.col("category")).otherwise(F.split("parent", "/")[0])
    is_text = dict(task_table.dtypes)["day"] == "string"
    assigned = task_table.where(not_in("day", ["unassigned"])) if is_text else task_table
    return (
        assigned.withColumn("day", as_date(assigned, "day"))
        .join(in_set, on, "left")
        .select(
            *keys,
            "name",
            "day",
            *date_parts("day", "year", "month"),
            "time_estimate",
            "start_time",
            "end_time",
            "duration_ms",
            "duration",
            shown.alias("category"),
        )
    )


def task_time_by_category(
    formatted: DataFrame,
    year: int,
    month: int,
    min_hours: float = 2,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Hours per category in one month, above a threshold; nothing for users whose hours sum to 0."""
    if "duration_ms" not in formatted.columns:
        formatted = formatted.withColumn("duration_ms", F.rint(F.col("duration") * HOUR_MS).cast("bigint"))
    shown = period_filter(formatted, Period("month", year, month), "day" if "day" in formatted.columns else None)
    hours = (
        shown.dropna(subset=[*keys, "category"])
        .groupBy(*keys, "category", "year", "month")
        .agg(F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("ms"))
    )
    # Joined on the month as well, which is constant, so that keys=() still has a key.
    on = [*keys, "year", "month"]
    active = hours.groupBy(*on).agg(F.sum("ms").alias("all_ms")).where("all_ms <> 0")
    lasting = hours.withColumn("duration", F.col("ms") / HOUR_MS).where(F.col("duration") > min_hours)
    return lasting.drop("ms").join(active, on, "left_semi")
