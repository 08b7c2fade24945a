"""Every registered query runs, and equals its DuckDB text where it has one."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from check_oracle import TABLES, compare

# The training-data operators have tests of their own.
PLANS = {n: p for n, p in entry_points.queries().items() if n != "pipeline" and not n.startswith("op")}
TEXTS = {n: t for n, t in entry_points.oracle_sql().items() if n in PLANS}


@pytest.fixture(scope="module")
def connection(sf):
    c = duckdb.connect()
    for table in TABLES:
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    return c


@pytest.mark.parametrize("name", list(PLANS))
def test_query(spark, sf, connection, name):
    verdict = compare(spark, connection, name, PLANS[name], TEXTS.get(name), sf)
    assert verdict.startswith(("ok", "rows-only")), verdict


def test_entry_points(spark):
    assert entry_points.entry(spark).count() > 0
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
