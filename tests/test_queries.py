"""Every query against its SQL on the smallest tables, and that all run."""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from maskloom.queries import ORACLE_SQL, QUERIES

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    return "None" if v is None or v != v else str(v)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    con.execute("set timezone = 'UTC'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sql, name):
    got = entry.queries()[name](spark, str(DATA)).toPandas()
    if name not in ORACLE_SQL:
        assert len(got) > 0
        return
    want = sql.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
