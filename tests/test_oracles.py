"""Every registered query against its SQL in DuckDB."""

import math

import duckdb
import pytest

from gridloom.plans.all import ORACLES, QUERIES

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings labels".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    res = duck.execute(ORACLES[name])
    cols = [c[0] for c in res.description]
    want = sorted([tuple(plain(r[cols.index(c)]) for c in sorted(cols)) for r in res.fetchall()], key=repr)
    df = QUERIES[name](spark, D)
    assert sorted(df.columns) == sorted(cols)
    got = sorted([tuple(plain(r[c]) for c in sorted(cols)) for r in df.collect()], key=repr)
    assert len(got) == len(want) and len(got) > 0
    for a, b in zip(got, want):
        assert all(x == y or (isinstance(x, float) and isinstance(y, (int, float)) and abs(x - y) <= 2e-5 * max(1, abs(x))) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    df = QUERIES[name](spark, D)
    assert df.count() > 0
