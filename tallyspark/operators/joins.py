"""Combining small per-key results."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def glue(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Put frames of one row per key side by side, keeping every key.

    One union and one aggregation instead of a chain of outer joins, so it also
    serves ``keys=()``, where a join would be a cross join.
    """
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    values = [c for c in stacked.columns if c not in keys]
    return stacked.groupBy(*keys).agg(*[F.max(c).alias(c) for c in values])


def tag_users(frames: dict[str, DataFrame]) -> DataFrame:
    """Union single-user frames, each tagged with its user."""
    tagged = [df.withColumn("user", F.lit(user)) for user, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
