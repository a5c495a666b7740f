"""Every core query against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from kmerflow import queries as core
from kmerflow.fixtures import TABLES

from .conftest import SF


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    if isinstance(v, (bool, str)):
        return str(v)
    return repr(round(float(v), 6) + 0.0)


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_query_equals_sql(spark, con, name):
    df = core.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    rel = con.sql(core.ORACLES[name])
    names = rel.columns
    assert sorted(names) == cols
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall())
