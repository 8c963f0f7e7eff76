"""Every query with a DuckDB twin gives the twin's rows on the smallest tables."""

import math
import os

import duckdb
import pytest

from tessera.plans import registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{FOLDER}/{name}')")
    return c


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, float):
        return round(value, 6)
    return str(value) if not isinstance(value, (int, bool)) else value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(([plain(r[k]) for k in order] for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_duckdb(spark, duck, name):
    got = registry.QUERIES[name](spark, FOLDER)
    want = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())


def test_every_query_has_columns(spark):
    for name, query in registry.QUERIES.items():
        if name not in registry.ORACLES:
            assert query(spark, FOLDER).columns, name
