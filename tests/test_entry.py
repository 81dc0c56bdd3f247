"""Every query with SQL gives the same rows as the SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_point
from dosecast.plans.views import TABLES
from tools.check import sorted_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(entry_point.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = entry_point.queries()[name](spark, SF)
    cursor = duck.execute(entry_point.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert sorted_rows(df.columns, df.collect()) == sorted_rows(columns, cursor.fetchall())


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.count() == 10 and "test_spearman" in df.columns
