"""Session defaults. Every one can be overridden by the cluster or by ``conf``."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    # Wall-clock columns are TIMESTAMP_NTZ; only epoch conversions read the zone.
    "spark.sql.session.timeZone": "UTC",
    # AQE sizes shuffles, turns small join sides into broadcasts by measured
    # size and splits hot join partitions.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Snapshots overwrite only the day they write.
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}

# Shuffles start wide enough for joins of whole tables; AQE merges what turns
# out small. A local session keeps its own small number.
CLUSTER = {
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
}


def get_session(app: str = "tallyspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session; without ``master`` the one spark-submit names."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    # The running context knows the master, however it was chosen.
    if not spark.sparkContext.master.startswith("local"):
        for key, value in CLUSTER.items():
            if key not in conf and spark.sparkContext.getConf().get(key) is None:
                spark.conf.set(key, value)
    return spark
