"""Dated snapshots: Parquet partitioned by ``snapshot_date``, all users in one table.

Users are a column and not a partition: a million users would mean a million small files a
day. Next to a dataset lies the list of users of each of its days, so that listings and
searches for a user read those and no data.

A day is two writes (its data, then its list of users). An empty marker file, written after
both and removed before a rerun or a drop touches either, makes the day visible: readers see
only marked days, so a crash or a reader between the writes sees the previous state.

Folders are listed and deleted through Hadoop's file systems, which a Spark Connect session
does not offer.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: only snapshots after this day count.
EARLIEST = dt.date(2019, 1, 1)
# Folder of the user lists, beside the datasets.
USERS_OF = "users_of"
# Folder of the markers of committed days, beside the datasets.
COMMITTED = "_committed"
LISTING = "dataset STRING, user STRING, snapshot_date DATE"


def write_snapshot(
    df: DataFrame,
    root: str,
    dataset: str,
    date: dt.date,
    cluster_by: Sequence[str] = (),
) -> None:
    """Write a dated copy; a rerun on the same day replaces that day only.

    ``cluster_by`` range-partitions by those columns so that readers of one user
    skip files. A hash of the row breaks ties, so a user holding a third of the
    rows still spreads over many tasks. The day's marker is removed first and
    written last, so the day is invisible while it is being replaced.
    """
    _set_marker(df.sparkSession, root, dataset, date, present=False)
    if cluster_by:
        tie = F.xxhash64(*df.columns)
        df = df.repartitionByRange(*cluster_by, tie).sortWithinPartitions(*cluster_by)
    _write_day(df, f"{root}/{dataset}", date)
    stored = df.sparkSession.read.schema(df.withColumn("snapshot_date", F.lit(date)).schema)
    written = stored.parquet(f"{root}/{dataset}").where(F.col("snapshot_date") == F.lit(date))
    owner = F.col("user") if "user" in df.columns else F.lit(None).cast("string")
    users = written.select(owner.alias("user")).distinct().sortWithinPartitions("user")
    _write_day(users, f"{root}/{USERS_OF}/{dataset}", date)
    _set_marker(df.sparkSession, root, dataset, date, present=True)


def _hadoop_path(spark: SparkSession, path: str):
    context = spark.sparkContext
    found = context._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(context._jsc.hadoopConfiguration())


def _set_marker(spark: SparkSession, root: str, dataset: str, date: dt.date, present: bool) -> None:
    path, fs = _hadoop_path(spark, f"{root}/{COMMITTED}/{dataset}/snapshot_date={date.isoformat()}")
    if present:
        fs.create(path, True).close()
    else:
        fs.delete(path, False)


def _write_day(df: DataFrame, path: str, date: dt.date) -> None:
    (
        df.withColumn("snapshot_date", F.lit(date))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("snapshot_date")
        .parquet(path)
    )


def snapshot_dates(spark: SparkSession, root: str, dataset: str) -> list[dt.date]:
    """Committed dates, oldest first, from the names of the markers alone."""
    path, fs = _hadoop_path(spark, f"{root}/{COMMITTED}/{dataset}/snapshot_date=*")
    found = fs.globStatus(path) or []
    names = [status.getPath().getName() for status in found]
    return sorted(dt.date.fromisoformat(name.split("=", 1)[1]) for name in names)


def _committed_users(spark: SparkSession, root: str, dataset: str, dates: list[dt.date]) -> DataFrame:
    """(user, snapshot_date) of the given committed days; the date filter prunes partitions."""
    stored = spark.read.schema("user STRING, snapshot_date DATE").parquet(f"{root}/{USERS_OF}/{dataset}")
    return stored.where(F.col("snapshot_date").isin(*dates))


def latest_snapshot(
    spark: SparkSession, root: str, dataset: str, user: str | None = None
) -> DataFrame:
    """The newest committed snapshot, or the newest that has a given user. Fails if there is none.

    The newest date comes from the markers. For a user, one job takes the maximum date over
    the committed lists of users; the lists are sorted by user within each file, so Parquet's
    min/max statistics skip row groups without the user, whatever the number of days. Data of
    the day found is all that is read.
    """
    dates = [date for date in snapshot_dates(spark, root, dataset) if date > EARLIEST]
    newest = None
    if dates and user is None:
        newest = dates[-1]
    elif dates:
        users = _committed_users(spark, root, dataset, dates).where(F.col("user") == user)
        newest = users.agg(F.max("snapshot_date").alias("newest")).first()["newest"]
    if newest is None:
        raise ValueError(f"no dated snapshot of {dataset} for {user or 'any user'}")
    found = spark.read.parquet(f"{root}/{dataset}/snapshot_date={newest.isoformat()}")
    return found if user is None else found.where(F.col("user") == user)


def list_snapshots(spark: SparkSession, root: str, datasets: Iterable[str]) -> DataFrame:
    """(dataset, user, snapshot_date) of every committed day, from the lists of users."""
    listing = None
    for dataset in datasets:
        dates = snapshot_dates(spark, root, dataset)
        if dates:
            part = _committed_users(spark, root, dataset, dates)
            part = part.select(F.lit(dataset).alias("dataset"), "user", "snapshot_date")
            listing = part if listing is None else listing.unionByName(part)
    return spark.createDataFrame([], LISTING) if listing is None else listing


def retention_plan(before: DataFrame, after: DataFrame) -> DataFrame:
    """Old snapshots to drop: all of a user's, once every dataset of theirs was refreshed.

    Both listings have (dataset, user, snapshot_date). Until the refresh is
    complete for a user, nothing of that user is dropped.
    """
    columns = ["dataset", "user", "snapshot_date"]
    fresh = after.join(before, columns, "left_anti").select("dataset", "user").distinct()
    expected = before.select("dataset", "user").distinct()
    missing = expected.join(fresh, ["dataset", "user"], "left_anti").select("user").distinct()
    return before.select(*columns).distinct().join(missing, "user", "left_anti").select(*columns)


def removable_dates(listing: DataFrame, plan: DataFrame) -> DataFrame:
    """(dataset, snapshot_date) partitions in which the plan covers every user."""
    kept = listing.join(plan, ["dataset", "user", "snapshot_date"], "left_anti")
    whole = ["dataset", "snapshot_date"]
    return listing.select(*whole).distinct().join(kept, whole, "left_anti")


def drop_snapshots(spark: SparkSession, root: str, removable: DataFrame) -> int:
    """Delete whole date partitions; returns how many. There is one row per dataset and day.

    The marker goes first, so readers stop seeing the day before any of its files go.
    """
    dropped = 0
    for row in removable.select("dataset", "snapshot_date").distinct().toLocalIterator():
        _set_marker(spark, root, row.dataset, row.snapshot_date, present=False)
        day = f"{row.dataset}/snapshot_date={row.snapshot_date.isoformat()}"
        for folder in (f"{root}/{day}", f"{root}/{USERS_OF}/{day}"):
            path, fs = _hadoop_path(spark, folder)
            gone = fs.delete(path, True)
        dropped += gone
    return dropped
