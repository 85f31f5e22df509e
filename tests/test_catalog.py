"""Every query on the driver's tables against an independent engine."""

import datetime
import decimal
from pathlib import Path

import duckdb
import pytest

from larkspur.catalog import core_queries, core_sql, flagship

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no driver tables here")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DATA}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, decimal.Decimal):
        return int(value)
    return str(value) if isinstance(value, (datetime.date, datetime.datetime)) else value


@pytest.mark.parametrize("name", list(core_queries()))
def test_same_rows(spark, oracle, name):
    df = core_queries()[name](spark, str(DATA))
    got = sorted(repr([plain(v) for v in row]) for row in df.collect())
    found = oracle.execute(core_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    assert got == sorted(repr([plain(row[i]) for i in order]) for row in found.fetchall())


def test_flagship(spark):
    assert flagship(spark, str(DATA)).count() > 0
