"""Every registered query against DuckDB on the given tables."""

import os
from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from catalog.oracle import ORACLE
from catalog.queries import QUERIES

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the given tables are not here")

TYPES = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE"}


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for path in sorted(DATA.glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def comparable(value):
    """Doubles by their text, so that NaN equals itself and 0.0 differs from -0.0."""
    return repr(value) if isinstance(value, float) else value


def in_order(rows, names):
    by_name = sorted(range(len(names)), key=lambda i: names[i])
    picked = [tuple(comparable(row[i]) for i in by_name) for row in rows]
    return sorted(picked, key=lambda row: tuple((v is None, str(type(v)), str(v)) for v in row))


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


def test_entry_has_rows(spark):
    assert entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, database, name):
    df = queries()[name](spark, str(DATA))
    cursor = database.execute(oracle_sql()[name])
    expected_types = {column[0]: str(column[1]) for column in cursor.description}
    expected = in_order(cursor.fetchall(), list(expected_types))
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema} == expected_types
    assert expected, "a check against no rows shows nothing"
    assert in_order([tuple(row) for row in df.collect()], df.columns) == expected
