"""All queries against their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from helixframe import queries

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", [n for n in queries.Q if n not in ("detect_heuristic",)])
def test_query(spark, name):
    rows = queries.Q[name](spark, SF)
    cols, got = sorted(rows.columns), rows.collect()
    if name not in queries.SQL:
        assert got
        return
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    r = con.sql(queries.SQL[name])
    assert sorted(r.columns) == cols
    at = [r.columns.index(c) for c in cols]
    want = sorted((tuple(x[i] for i in at) for x in r.fetchall()), key=repr)
    assert sorted((tuple(x[c] for c in cols) for x in got), key=repr) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
