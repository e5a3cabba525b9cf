"""Every query runs on the smallest tables, with stable columns, and equals its SQL where there is one."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

CORE = sorted(entry.catalogue.queries())


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if hasattr(value, "isoformat"):
        return value.replace(tzinfo=None).isoformat() if hasattr(value, "tzinfo") else value.isoformat()
    if isinstance(value, float):
        return int(value) if math.isfinite(value) and value == int(value) else round(value, 9)
    return value


@pytest.fixture(scope="module")
def duck(small):
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{small}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return db


@pytest.mark.parametrize("name", CORE)
def test_query(spark, small, duck, name):
    df = entry.queries()[name](spark, small)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if sql := entry.oracle_sql().get(name):
        result = duck.sql(sql)
        assert sorted(result.columns) == columns
        at = [result.columns.index(c) for c in columns]
        assert rows == sorted((tuple(plain(r[k]) for k in at) for r in result.fetchall()), key=repr)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["day", "grp"] and df.count() > 0


def test_every_query_without_sql_is_tested_elsewhere():
    assert set(CORE) - set(entry.catalogue.oracle_sql()) == {"packed_lines", "page_blocks", "number_contexts", "math_found"}
