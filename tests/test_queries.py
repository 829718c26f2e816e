"""Every registered query of the engine against its SQL, on the smallest tables."""

import datetime
import os

import duckdb
import pytest

from codicil.plans import registry

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)[:10] if isinstance(v, datetime.date) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got
    if name in SQL:
        out = duck.execute(SQL[name])
        names = [d[0] for d in out.description]
        assert sorted(names) == columns
        assert sorted(tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in out.fetchall()) == got
