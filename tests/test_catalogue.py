"""Every query that has SQL against DuckDB, over the smallest tables; the others must run."""

import glob
import math
import os

import duckdb
import pytest

from trendloom import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
#: Their shape is asserted elsewhere, and they are slow on so small a machine.
SLOW = {"score_without_lookahead", "retrospective_first_useful"}


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(columns, found):
    def plain(v):
        if isinstance(v, float):
            return None if math.isnan(v) else v
        return str(v)[:19].removesuffix(" 00:00:00") if hasattr(v, "isoformat") else v

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - SLOW))
def test_query(spark, db, name):
    df = catalogue.queries()[name](spark, DATA)
    got = rows(df.columns, df.collect())
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    want = db.execute(sql)
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows(columns, want.fetchall())
