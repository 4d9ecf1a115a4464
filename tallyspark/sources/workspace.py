"""Shared work folder for intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def work_path(spark: SparkSession, name: str) -> str:
    """A new path under the folder named in ``spark.checkpoint.dir``, which all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str, replaces: DataFrame | None = None) -> DataFrame:
    """Write once and read back: cuts the lineage, outlives executors, leaves exact statistics.

    ``replaces``: an earlier settled table that nothing needs any more; its files go.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.settled_at = path
    if replaces is not None:
        discard(replaces)
    return written


def discard(df: DataFrame) -> None:
    """Remove the files of a settled table."""
    context = df.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(df.settled_at)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
