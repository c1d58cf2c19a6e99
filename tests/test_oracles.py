"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.check import TABLES, compare


@pytest.fixture(scope="module")
def connection(data):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(name for name in queries() if name in oracle_sql()))
def test_query_matches_sql(spark, data, connection, name):
    verdict = compare(spark, connection, data, name)
    assert verdict.startswith(("ok", "rows only")), verdict


def test_every_query_has_its_sql():
    apart = {name for name in queries() if name == "pipeline" or name.startswith("op")}
    assert set(queries()) - apart <= set(oracle_sql())


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0
