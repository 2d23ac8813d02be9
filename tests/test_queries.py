"""Every registered query against its SQL twin in DuckDB, on the smallest data folder."""

import datetime
import decimal
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract

DATA = Path(os.environ.get("MARKET_TEST_DATA", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data here")
ORACLES = contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for file in DATA.glob("*.parquet"):
        con.sql(f"create view {file.stem} as select * from '{file}'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.date()
    return value


def ordered(rows):
    return sorted(rows, key=lambda row: [(v is None, str(type(v)), v if v is not None else 0) for v in row])


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, duck, name):
    df = contract.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    rows = ordered(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in ORACLES:
        assert rows
        return
    result = duck.sql(ORACLES[name])
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    assert rows == ordered(tuple(plain(r[i]) for i in at) for r in result.fetchall())


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(contract.queries())
