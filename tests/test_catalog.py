"""Every query against its SQL, at the smallest scale."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as contract

FOLDER = contract.SMOKE_DIR
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _text(v):
    """Numbers as text: whole ones exact, others to ten digits, as sums of doubles depend on their order."""
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if not isinstance(v, (int, float)):
        return str(v)
    return repr(float(v)) if float(v).is_integer() else f"{v:.10g}"


def _comparable(row):
    return tuple(_text(v) for v in row)


@pytest.mark.parametrize("name", list(contract.queries()))
def test_query(spark, duck, name):
    df = contract.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(_comparable(r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    assert got
    sql = contract.oracle_sql().get(name)
    if sql:
        names = ", ".join(f'"{c}"' for c in columns)
        assert got == sorted(_comparable(r) for r in duck.execute(f"SELECT {names} FROM ({sql})").fetchall())


def test_entry(spark):
    assert contract.entry(spark).count() > 0
