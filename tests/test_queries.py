"""Every registered query against its SQL (tools/compare.py does the same by name)."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from compare import TABLES, rows  # noqa: E402

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402

NAMES = sorted(oracle_sql())


@pytest.fixture(scope="module")
def db(sf):
    import duckdb

    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sf, db, name):
    got, want = queries()[name](spark, sf).toPandas(), db.execute(oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


def test_entry(spark, sf):
    assert entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
