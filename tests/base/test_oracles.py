"""Every registered query of the library against its SQL on the small tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from listenlake.plans import queries, registry  # noqa: F401


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def tidy(table):
    names = sorted(table.column_names)
    fix = lambda v: round(v, 6) if isinstance(v, float) else str(v) if isinstance(v, list) else v
    rows = [tuple(map(fix, r)) for r in zip(*(table.column(c).to_pylist() for c in names))]
    return names, sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, sf, duck, name):
    got = tidy(registry.QUERIES[name](spark, sf).toArrow())
    want = tidy(duck.sql(registry.SQL[name]).to_arrow_table())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())
