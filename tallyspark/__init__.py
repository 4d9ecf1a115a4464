"""Household money, habit, task, mood and sleep analytics on Spark DataFrames."""

from tallyspark.operators.periods import Period

__all__ = ["Period"]
