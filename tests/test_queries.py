"""Every document query against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from quillon.plans.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    found = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        found.sql(f"CREATE VIEW {os.path.basename(f).removesuffix('.parquet')} AS SELECT * FROM '{f}'")
    return found


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(spark, db, name):
    got, want = QUERIES[name](spark, FOLDER), db.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in got.columns]
    expected = sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())
    assert expected and sorted(repr(tuple(r)) for r in got.collect()) == expected
