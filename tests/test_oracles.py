"""Every query of the catalog that has SQL, against DuckDB on the smallest tables."""

import glob
import os

import pytest

from tessera.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(value):
    if value is None or value != value:
        return None
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, float):
        return float(f"{value:.6g}")
    return [plain(v) for v in value] if isinstance(value, list) else value


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    sql = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(sql.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(sql.columns, sql.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).collect() is not None
