"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as driver
from check import TABLES, same

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(driver.queries()))
def test_query(spark, db, name):
    got = driver.queries()[name](spark, FOLDER).toPandas()
    assert len(got)
    if name in driver.oracle_sql():
        assert same(got, db.sql(driver.oracle_sql()[name]).df()) == "ok"


def test_entry(spark):
    assert driver.entry(spark).columns == ["query_id", "_id", "distance", "score", "rank"]
