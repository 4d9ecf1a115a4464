"""User configuration: maps of lists and targets, read as dimension tables.

Login sections of a configuration are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators.ledger import category_dim

MAP_OF_LISTS = "MAP<STRING, ARRAY<STRING>>"


def read_config(
    spark: SparkSession,
    path: str,
    targets: str = "attribute_config.key_habits",
    rollup: str = "task_config.aggregate_categories",
    multi_line: bool = True,
) -> DataFrame:
    """One row per configuration file ``<user>_config.json``.

    ``targets`` and ``rollup`` say where a file keeps the attribute targets and
    the task rollup list.
    """
    target_section, target_field = targets.split(".")
    rollup_section, rollup_field = rollup.split(".")
    schema = (
        f"user STRING, aggregate_categories {MAP_OF_LISTS}, meta_categories {MAP_OF_LISTS}, "
        f"`{target_section}` STRUCT<`{target_field}`: MAP<STRING, DOUBLE>>, "
        f"`{rollup_section}` STRUCT<`{rollup_field}`: ARRAY<STRING>>"
    )
    from_file = F.regexp_extract("_metadata.file_name", r"^(.*)_config\.json$", 1)
    return (
        spark.read.schema(schema)
        .option("multiLine", multi_line)
        .json(path)
        .select(
            F.coalesce("user", F.nullif(from_file, F.lit(""))).alias("user"),
            "aggregate_categories",
            "meta_categories",
            F.col(targets).alias("targets"),
            F.col(rollup).alias("rollup"),
        )
    )


def map_rows(config: DataFrame, column: str, key: str, value: str) -> DataFrame:
    """Rows of a map of lists; NULL list entries are padding and vanish."""
    return (
        config.select("user", F.explode(column).alias(key, "items"))
        .select("user", key, F.explode("items").alias(value))
        .where(F.col(value).isNotNull())
    )


def category_dim_of(config: DataFrame) -> DataFrame:
    meta = map_rows(config, "meta_categories", "meta_category", "category")
    aggregate = map_rows(config, "aggregate_categories", "category", "name")
    return category_dim(meta, aggregate)


def habit_targets(config: DataFrame) -> DataFrame:
    return config.select("user", F.explode("targets").alias("attribute", "target"))


def task_rollup_set(config: DataFrame) -> DataFrame:
    return config.select("user", F.explode("rollup").alias("category")).distinct()
