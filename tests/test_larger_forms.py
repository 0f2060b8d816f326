"""Registered queries against their SQL on tables with larger values than the given ones."""

import pytest

import __spark_entry__ as entry_points
from tests.test_registered import table

ORDERS = "cast(id as bigint) as o_orderkey, cast(id % 400 + 100000 as bigint) as o_custkey, if(id % 3 = 0, 'F', 'O') as o_orderstatus, 5e9D as o_totalprice"
EVEN = "id as event_id, timestamp_ntz'2024-01-01' + make_dt_interval(int(id % 3)) as ts, id % 9000 as user_id, if(id % 10 = 0, 'rare', 'view') as event_type, double(id) as value"
CASES = {"json_forms": ("orders", ORDERS, 400), "parity_null_keys": ("orders", ORDERS, 400), "stored_sketches": ("events", EVEN, 60_000)}


@pytest.mark.parametrize("name", CASES)
def test_query(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    relation, columns, n = CASES[name]
    spark.sql(f"select {columns} from range({n})").write.parquet(f"{tmp_path}/{relation}.parquet")
    df = entry_points.queries()[name](spark, str(tmp_path))
    with duckdb.connect() as engine:
        engine.execute(f"CREATE VIEW {relation} AS SELECT * FROM '{tmp_path}/{relation}.parquet/*.parquet'")
        result = engine.execute(entry_points.oracle_sql()[name])
        assert table(df.columns, df.collect()) == table([c[0] for c in result.description], result.fetchall())
