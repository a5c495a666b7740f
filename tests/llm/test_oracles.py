"""Every query of the operators that SQL can express, against its SQL in DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from kmerflow.llm import queries

TABLES = ["documents", "embeddings", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    return str(v) if isinstance(v, (bool, str)) else repr(round(float(v), 6) + 0.0)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf, con, name):
    df = queries.queries()[name](spark, sf)
    rel = con.sql(queries.oracle_sql()[name])
    cols, names = sorted(df.columns), rel.columns
    assert sorted(names) == cols
    assert sorted(tuple(plain(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall())
