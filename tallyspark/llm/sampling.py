"""Bounded samples of labelled rows for fitting models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RANGE = 1 << 30


def hash_sample(rows: DataFrame, size: int, *by: str) -> DataFrame:
    """At most ``size`` rows, chosen by a hash of ``by`` over all of them.

    A share by hash is cut first, so what each task hands to the ordering shrinks as the table
    grows. Counts the rows; a costly table is best written before.
    """
    total = rows.count()
    if total > 2 * size:
        share = int(_RANGE * 1.5 * size / total)
        rows = rows.where(F.pmod(F.xxhash64(*by), F.lit(_RANGE)) < share)
    return rows.orderBy(F.xxhash64(*by), *rows.columns).limit(size)
