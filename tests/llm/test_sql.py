"""Operators against their SQL on small tables that hold what the given tables lack."""

import pytest

from helixframe.llm import decontam, licenses
from helixframe.llm.queries import ORACLES

duckdb = pytest.importorskip("duckdb")


def same(df, sql, **tables):
    """The query's rows equal those of the SQL over the tables."""
    con = duckdb.connect()
    for name, table in tables.items():
        con.register(name, table.toPandas())
    r, cols = con.sql(sql), sorted(df.columns)
    assert sorted(r.columns) == cols
    at = [r.columns.index(c) for c in cols]
    want = sorted((tuple(x[i] for i in at) for x in r.fetchall()), key=repr)
    got = sorted((tuple(x[c] for c in cols) for x in df.collect()), key=repr)
    assert got == want
    return got


def test_decontamination(spark):
    item = "when Anna and Al Bo buy 12 apples at 3.50 euros each, how many coins of 2 euros does Anna need for all 12 apples"
    texts = [
        item,
        "before. " + item + " after",
        "x " + item.replace("Anna", "Berta").replace("12", "31").replace("3.50", "7") + " y",  # other values, consistent
        item.replace("12", "31", 1),  # a value that stands for two
        item[:60],
        "Ada Bea Cy Di Ed, Flo; Gus 1/2 3:4 m km " * 9,
        None,
        "",
        "short one here",
        "so a short one here it is",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, "short one here"), (3, None), (4, "1 2 3 4 5 6 7 8 9"), (5, item)], "item_id long, text string")
    rows = same(decontam.query(docs, bench), ORACLES["op1_benchmark_decontamination"], documents=docs, benchmark=bench)
    # Columns in order: coverage, doc_id, item_id, item_windows, matched_windows, reparameterised.
    assert {(r[1], r[5]) for r in rows if r[2] == 1} >= {(0, False), (1, False), (2, True)}
    assert {r[1] for r in rows if r[2] == 2} == {8, 9}


def test_license_scans(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    texts = {1000: gpl, 1001: "plain text", 1010: f"code\n\n{mit}\n\nmore", 1011: None, 1012: "", 1105: "a line\r\n" + gpl + "\nanother", 2001: "nothing", 1110: "license license", 1130: mit + "\n" + gpl}
    rows = [(i, t, None if i == 2001 else "web", "en" if i % 2 else None) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = same(licenses.query(docs), ORACLES["op3_license_scans"], documents=docs)
    # Columns in order: doc_id, license, license_dir, origin, path, score.
    by = {r[0]: r for r in got}
    assert by[1105][1] == "GPL-3.0" and by[1010][1] == "MIT" and by[2001][1] is None
    assert by[1001][1:4] == ("GPL-3.0", "web", "inherited") and by[1012][1:4] == ("MIT", "web/none/10", "inherited")
