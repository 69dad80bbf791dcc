"""Every query with checking SQL gives the same rows as that SQL."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
CHECKS = entry.oracle_sql()
NAMES = sorted(CHECKS)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def cell(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, db, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(cell(r[c]) for c in cols)) for r in df.collect())
    cur = db.execute(CHECKS[name])
    at = {d[0]: i for i, d in enumerate(cur.description)}
    assert sorted(at) == cols
    want = sorted(repr(tuple(cell(r[at[c]]) for c in cols)) for r in cur.fetchall())
    assert got == want


def test_every_check_belongs_to_a_query():
    assert set(CHECKS) <= set(entry.queries())
