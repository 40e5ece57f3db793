"""Every registered query against its DuckDB oracle on the sf0.001 tables,
plus the driver contract (entry / queries / oracle_sql)."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from fleetlens.plans.oracle import SQL
from fleetlens.plans.queries import QUERIES
from fleetlens.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


def norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (2, str(v))
    if isinstance(v, (int, float)):
        if isinstance(v, float) and math.isnan(v):
            return (1, "nan")
        return (1, f"{float(v):.9g}")
    if hasattr(v, "isoformat"):
        return (4, v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat())
    return (6, str(v))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_contract(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    sdf = QUERIES[name](spark, SF)
    cols = sorted(sdf.columns)
    srows = sorted(tuple(norm(r[c]) for c in cols) for r in sdf.collect())
    rel = con.sql(SQL[name])
    dcols = rel.columns
    order = sorted(range(len(dcols)), key=lambda i: dcols[i])
    drows = sorted(tuple(norm(r[i]) for i in order) for r in rel.fetchall())
    assert cols == sorted(dcols)
    assert srows == drows
