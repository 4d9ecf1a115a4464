"""Every registered query against its SQL counterpart on the given tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tallyspark.plans import catalogue

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()
QUERIES = {name: entry.queries()[name] for name in catalogue.queries()}


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for file in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(file).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{file}'")
    return connection


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    return repr(value) if isinstance(value, float) else str(value)


def content(pdf):
    ordered = pdf[sorted(pdf.columns)].astype(object)
    return sorted(tuple(map(plain, row)) for row in ordered.itertuples(index=False))


def test_every_query_has_sql():
    assert set(QUERIES) <= set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, tables, name):
    found = QUERIES[name](spark, SF).toPandas()
    expected = tables.execute(SQL[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert content(found) == content(expected)


def test_entry(spark):
    found = entry.entry(spark)
    assert found.count() > 0 and "diff" in found.columns
