"""Every registered query with SQL against DuckDB on the smallest tables; the others must at least run."""

import os
from pathlib import Path

import duckdb
import pytest

from fieldloom.plans.catalog import ORACLE, QUERIES

HERE = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not HERE.exists():
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{HERE}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float) or hasattr(v, "as_tuple"):
        return round(float(v), 6)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v if v is None or isinstance(v, int | str) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_its_sql(spark, duck, name):
    df = QUERIES[name](spark, str(HERE))
    got = sorted((tuple(map(plain, r)) for r in df.collect()), key=repr)
    want = duck.execute(ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    at = [columns.index(c) for c in df.columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_runs(spark, name):
    if not HERE.exists():
        pytest.skip("no test tables")
    assert QUERIES[name](spark, str(HERE)).count() >= 0
