"""Contiguous shards of near equal bytes from global prefix sums.

Rows are range-partitioned by key; each partition's total is one small row, a running
sum over those totals gives every partition its offset, and a running sum inside each
partition does the rest. Only the totals, one row a partition, ever meet in one task.

Edge cases: NULL keys sort first; rows of equal keys keep the order of the input scan
and may be split over partitions and shards; a NULL size counts as 0; an empty table
gives no rows; other columns pass through (names starting with ``_s_`` are reserved).
Input columns named ``start``, ``shard`` or ``slot`` (in any case) are replaced by the
results of those names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.sources.workspace import settle


def shard_by_bytes(
    rows: DataFrame, n_shards: int = 16, size: str = "size", key: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """The rows with ``start`` (sizes before it), ``shard`` and ``slot`` (gapless from 0).

    A row belongs to the shard in whose equal share of all bytes it starts, so shards are
    contiguous in key order and differ from the target by less than one row's size.
    """
    order = [*(F.asc_nulls_first(k) for k in key), F.asc("_s_scan")]
    placed = (
        rows.withColumn("_s_scan", F.monotonically_increasing_id())
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumns(
            {"_s_part": F.spark_partition_id(), "_s_size": F.coalesce(size, F.lit(0)).cast("bigint")}
        )
    )
    placed = settle(placed, "shard-order")
    totals = placed.groupBy("_s_part").agg(F.sum("_s_size").alias("b"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("_s_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_s_part").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    offsets = totals.select(
        "_s_part",
        F.coalesce(F.sum("b").over(before), F.lit(0)).alias("_s_bytes"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_s_rows"),
        F.greatest(F.sum("b").over(everything), F.lit(1)).alias("_s_total"),
    )
    inside = Window.partitionBy("_s_part").orderBy(*order)
    running = F.sum("_s_size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    indexed = placed.withColumns({"_s_run": running - F.col("_s_size"), "_s_n": F.row_number().over(inside)})
    indexed = indexed.join(offsets, "_s_part").withColumns(
        {
            "start": F.col("_s_bytes") + F.col("_s_run"),
            "_s_index": F.col("_s_rows") + F.col("_s_n") - 1,
        }
    )
    share = F.expr(f"start * {int(n_shards)}L div _s_total").cast("int")
    indexed = indexed.withColumn("shard", F.least(share, F.lit(n_shards - 1)))
    first = indexed.groupBy("shard").agg(F.min("_s_index").alias("_s_first"))
    return (
        indexed.join(first, "shard")
        .withColumn("slot", F.col("_s_index") - F.col("_s_first"))
        .select(*_kept(rows, ("start", "shard", "slot")), "start", "shard", "slot")
    )


def _kept(rows: DataFrame, results: Sequence[str]) -> list[str]:
    """Input columns that pass through: all but those the results replace (any case)."""
    replaced = {name.lower() for name in results}
    return [name for name in rows.columns if name.lower() not in replaced]


def write_shards(docs: DataFrame, path: str, n_shards: int = 16, text: str = "text") -> None:
    """Whole documents as one folder a shard, in slot order inside each file.

    Input columns named ``shard``, ``slot``, ``start`` or ``_s_size`` (in any case) are not
    written; ``shard`` and ``slot`` hold the placement.
    """
    sized = docs.select(*_kept(docs, ("start", "shard", "slot", "_s_size")))
    sized = sized.withColumn("_s_size", F.coalesce(F.octet_length(text), F.lit(0)) + 1)
    placed = shard_by_bytes(sized, n_shards, "_s_size").drop("_s_size", "start")
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
