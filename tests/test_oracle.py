"""Every registered query against its SQL on the smallest given tables."""

import datetime as dt
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from quizlake.plans.oracle import oracle_queries
from quizlake.plans.queries import registered

FOLDER = "/root/testdata/sf0.001"
KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP",
}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables not present")


@pytest.fixture
def duck():
    """A connection per test: an error in one statement leaves the others alone."""
    with duckdb.connect() as connection:
        for path in glob.glob(f"{FOLDER}/*.parquet"):
            name = os.path.basename(path).removesuffix(".parquet")
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
        yield connection


def test_every_query_has_sql():
    assert registered().keys() == oracle_queries().keys()


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(registered()))
def test_query_equals_sql(spark, duck, name):
    frame = entry_point.queries()[name](spark, FOLDER)
    sql = entry_point.oracle_sql()[name]
    columns = sorted(frame.columns)
    kinds = {row[0]: row[1] for row in duck.execute(f"DESCRIBE {sql}").fetchall()}
    assert {c: KINDS[k] for c, k in frame.dtypes} == kinds

    def text(value):
        return value.isoformat() if isinstance(value, dt.datetime) else repr(value)

    got = sorted(tuple(text(row[c]) for c in columns) for row in frame.collect())
    cursor = duck.execute(sql)
    places = [[d[0] for d in cursor.description].index(c) for c in columns]
    expected = sorted(tuple(text(row[i]) for i in places) for row in cursor.fetchall())
    assert got == expected
