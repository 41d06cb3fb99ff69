"""The registered queries against their SQL, on the smallest tables."""

from __future__ import annotations

import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from viewloom import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(x):
    return str(x.normalize()) if isinstance(x, Decimal) else repr(x)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    want = duck.sql(Q.SQL[name])
    assert sorted(want.columns) == names
    got = sorted([_plain(v) for v in r] for r in df.select(*names).collect())
    rows = duck.sql(f"SELECT {', '.join(f'"{n}"' for n in names)} FROM want").fetchall()
    assert got == sorted([_plain(v) for v in r] for r in rows)
    assert got


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(Q.QUERIES) == set(Q.SQL)
