"""Every query of the library against its SQL in DuckDB, on the smallest tables."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

from kbspark.plans.registry import ORACLE_SQL, QUERIES
from tests.conftest import DATA


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)) and not isinstance(v, bool):
        return round(float(v), 9)
    return str(v) if isinstance(v, (datetime.date, datetime.datetime)) else v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in values)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLE_SQL:
        assert df.columns
        return
    cursor = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, got) == rows(names, cursor.fetchall())
