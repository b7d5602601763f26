"""Every query with SQL, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from tracequill.plans import registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for name in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return c


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda x: round(float(x), 5) if isinstance(x, float) else x if x is None else str(x)
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, tables, name):
    got = registry.QUERIES[name](spark, FOLDER)
    expected = tables.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in expected.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, expected.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).count() > 0
