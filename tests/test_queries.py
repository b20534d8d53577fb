"""Every registered query of the engine against its SQL on the smallest tables."""

import os
from collections import Counter

import pytest

from lodestar.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{name}')")
    return con


def plain(v):
    return round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def rows(names, got):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in got)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    done = duck.execute(ORACLES[name])
    columns = [c[0] for c in done.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, done.fetchall())
