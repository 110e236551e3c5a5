"""Each registered query against its SQL in DuckDB, at the smallest scale."""

import glob
import math
import os

import duckdb
import pytest

from tessera import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(float(v), 5) if isinstance(v, float) else v
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(name, spark, db):
    got = registry.QUERIES[name](spark, SF)
    want = db.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_rows_only(name, spark):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry_imports_alone():
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
