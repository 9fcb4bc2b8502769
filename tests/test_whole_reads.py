"""Reads of the queries without SQL hold all letters of the texts."""

import re

from helixframe import queries

CODE = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTANGTACGTACGTAC")


def _tables(spark, folder):
    texts = ["ab c, " * 200 + "end", "Short", "", "12 34", None, "x" * 100, "y" * 101, "é" + "Gattaca\n" * 50]
    spark.createDataFrame(list(enumerate(texts, 7)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return {i: re.sub("[^A-Za-z]", "", t or "").upper().translate(CODE) for i, t in enumerate(texts, 7)}


def test_pieces(spark, tmp_path):
    want = _tables(spark, tmp_path)
    rows = sorted(queries.reads(spark, str(tmp_path)).collect())
    got = {i: "".join(r.sequence for r in rows if r.read_idx >> 25 == i) for i in want}
    assert got == want
    assert len({r.read_idx for r in rows}) == len({r.name for r in rows}) == len(rows) == sum(max(1, -(-len(t) // 100)) for t in want.values())
    assert all(len(r.sequence) == len(r.qualities) <= 100 for r in rows)


def test_pair_pieces(spark, tmp_path):
    """Mates hold all letters in inserts; where the id says so one base of a mate differs, or the second mate is no mate."""
    want = _tables(spark, tmp_path)
    rows = sorted(queries.pair_reads(spark, str(tmp_path)).collect(), key=lambda r: r.read_idx)
    assert all(len(m.sequence) == len(m.qualities) <= 80 for r in rows for m in (r.r1, r.r2))
    seen = set()
    for i, text in want.items():
        size, own = 40 + i % 40, [r for r in rows if r.read_idx >> 25 == i]
        inserts = [text[k : k + size] for k in range(0, len(text), size)] or [""]
        assert len(own) == len(inserts)
        for k, (x, r) in enumerate(zip(inserts, own)):
            v = i * 7 + k
            back = x[::-1] if v % 7 == 0 else x.translate(str.maketrans("ACGT", "TGCA"))[::-1]
            for mate, wanted, wrong in ((r.r1, (x + queries.ADAPTER1)[:80], v % 2 == 1), (r.r2, (back + queries.ADAPTER2)[:80], v % 4 >= 2)):
                differ = sum(a != b for a, b in zip(mate.sequence, wanted))
                assert len(mate.sequence) == len(wanted) and differ <= wrong
                seen.add(differ)
    assert seen == {0, 1}


def test_adapter_past_the_first_letters(spark, tmp_path):
    motif = "TACGTACGTACGAAGT".translate(str.maketrans("ACGT", "ABCD"))
    spark.createDataFrame([(1, "a" * 130 + motif + "c" * 20)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.Q["adapter_dp_back"](spark, str(tmp_path)).orderBy("read_idx").collect()
    assert [r.sequence for r in rows] == ["A" * 100, "A" * 30] and rows[1].adapter_name == "x"
