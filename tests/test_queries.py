"""Every registered query against its SQL in DuckDB, over the smallest driver tables where they are there."""

import math
import os

import duckdb
import pytest

from lodestrata.plans import registry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no driver tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF_DIR}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    found = registry.queries()[name](spark, SF_DIR)
    columns = sorted(found.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=repr)
    if name not in registry.oracle_sql():
        assert got
        return
    answer = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(row[names.index(c)]) for c in columns) for row in answer.fetchall()), key=repr)
    assert got == want


def test_entry_registers_them_all(spark):
    import __spark_entry__

    assert set(registry.queries()) <= set(__spark_entry__.queries()) and set(registry.oracle_sql()) <= set(__spark_entry__.oracle_sql())
    assert __spark_entry__.entry(spark).columns == ["n", "vec_id", "label", "similarity"]
