"""Every driver query with SQL, against DuckDB on the same tables."""

import datetime
import glob
import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")
from codeloom.plans import catalog  # noqa: E402

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    found = catalog.queries()[name](spark, DATA)
    got = rows(found.columns, [tuple(r) for r in found.collect()])
    r = duck.sql(catalog.oracle_sql()[name])
    assert got == rows(r.columns, r.fetchall())
