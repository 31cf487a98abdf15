"""Every query with SQL gives the rows of the SQL, on the smallest tables."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from quarrylens.plans import queries as core

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return int(v) if hasattr(v, "as_integer_ratio") and v == int(v) and not isinstance(v, bool) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query(spark, duck, name):
    frame = core.queries()[name](spark, DATA)
    columns = sorted(frame.columns)
    rows = Counter(tuple(norm(r[c]) for c in columns) for r in frame.collect())
    sql = core.oracle_sql().get(name)
    if sql:
        found = duck.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        assert rows == Counter(tuple(norm(dict(zip(names, r))[c]) for c in columns) for r in found.fetchall())


def test_entry_has_rows_and_every_oracle_a_query(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
