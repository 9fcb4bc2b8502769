"""Items whose windows are mostly placeholders."""

from helixframe.llm import decontam

SHORT = "What is 15 plus 27?"
LONG = "solve 1 2 3 4 5 6 7 8 plus 9 10 11 12 13 14 15 minus 16 17 18 19 20 21 22 equals 23 24 25 26 27 28 29 30"


def test_number_heavy(spark):
    other = LONG.replace("17", "99").replace("30", "77")
    texts = [f"so. {SHORT} yes", "so. What is 16 plus 28? yes", f"so. {LONG} end", f"so. {other} end", "3 4 5 6 7 8", f"x {SHORT[5:]} y", "list 4 5 6 7 8 9 end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, SHORT), (2, LONG), (3, "4 5 6 7 8 9")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.reparameterised, r.coverage) for r in decontam.query(docs, bench).collect())
    assert [g for g in got if g[1] == 1] == [(0, 1, False, 1.0)]
    assert [g for g in got if g[1] == 2] == [(2, 2, False, 1.0), (3, 2, True, 1.0)]
    assert {g[0] for g in got if g[1] == 3} == {6}
