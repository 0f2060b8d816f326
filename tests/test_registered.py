"""Every registered query against its SQL, on the smallest data set."""

import os
from decimal import Decimal
from pathlib import Path

import pytest

import __spark_entry__ as entry_points
from catalog import load

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
QUERIES, SQL = dict(load().QUERIES), dict(load().SQL)
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="the given tables are not here")


@pytest.fixture(scope="module")
def engine():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, Decimal)):
        return Decimal(value).normalize() + 0
    return value


def table(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(row[i]) for i in order) for row in data]
    return sorted(names), sorted(out, key=lambda t: tuple((v is None, str(v)) for v in t))


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, engine, name):
    df = QUERIES[name](spark, str(DATA))
    got = table(df.columns, df.collect())
    if name in SQL:
        result = engine.execute(SQL[name])
        names = [c[0] for c in result.description]
        assert got == table(names, result.fetchall())
    else:
        assert got[1]


def test_registry():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) > 100
    assert sorted(set(QUERIES) - set(SQL)) == ["construct_scan", "inventory_items"]


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
