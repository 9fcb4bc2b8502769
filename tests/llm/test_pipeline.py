"""The pipeline's stages over a small table, and their effects."""

import random

from pyspark.sql import functions as F

import corpus_pipeline as p


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)] + ["the", "house", "of"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    bench = "Anna buys twelve apples and gives five of them to her old friend before the long walk home"
    rows = [(i, text(40), "en", f"s{i % 3}") for i in range(60)]
    rows += [(i, text(30) + " stupid idiot " + text(5), "en", "s1") for i in range(100, 140)]
    rows += [(200, rows[3][1], "en", "s2"), (201, text(20) + " . " + bench, "en", "s0"), (202, "123 ...", "en", "s0"), (203, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long")).withColumn("score", F.lit(7))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 0) for i in range(60)] + [(i, 1) for i in range(100, 140)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    now = docs
    for k, (name, stage) in enumerate(p.STAGES):
        now = p.stored(stage(spark, now, str(tmp_path)), name)
        if k < 4:
            assert now.columns == docs.columns and now.where("score <> 7").count() == 0
        ids = {r.doc_id for r in now.collect()}
        if k == 0:
            assert ids == {r[0] for r in rows} - {202, 203}
        if k == 1:
            assert not ids & set(range(100, 140)) and len(ids & set(range(60))) == 60
        if k == 2:
            assert 200 not in ids and 3 in ids
        if k == 3:
            assert 201 not in ids and len(ids) == 60
    assert now.where("copies < 1 or copies > 2").count() == 0
    assert p.run(spark, str(tmp_path)).count() == now.count()


def run_stage(spark, tmp_path, k, docs):
    return p.stored(p.STAGES[k][1](spark, docs, str(tmp_path)), "t")


def tables(spark, tmp_path, labels=()):
    spark.createDataFrame(list(labels), "doc_id long, toxic int").write.mode("overwrite").parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "the very first question of a small benchmark that nobody else would ask at all")], "item_id long, text string").write.mode("overwrite").parquet(str(tmp_path / "benchmark.parquet"))


CLASH = ("size", "target", "taken", "copies", "source_size", "node", "component", "lang_pred", "score", "row", "n", "id", "h", "m", "key", "rep", "__node", "label", "part", "own", "several")


def test_repeated_rows_null_ids_and_clashing_names(spark, tmp_path):
    tables(spark, tmp_path)
    rng = random.Random(2)
    text = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    twice, nameless, long_ = text(30), text(30), text(30_000)
    rows = [(1, twice, "en", "a"), (1, twice, "en", "a"), (1, twice, "en", "a"), (None, nameless, "en", "b"), (None, nameless, "en", "b"), (None, text(20), "en", None), (None, twice, "en", None)]
    rows += [(2, text(25), "de", "a"), (2, text(25), "de", "a"), (3, None, None, "a"), (None, None, None, None), (4, "", "en", "b"), (5, long_, "en", "b"), (6, long_ + " x", "en", "b")]
    rows += [(10 + i, text(40), "en", "ab"[i % 2]) for i in range(20)]
    for clash in ((), CLASH):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit("x") for c in clash})
        key = lambda r: repr((r.doc_id, r.text))
        want = sorted(repr(r[:2]) for r in rows)
        for k in (0, 1, 2, 3):
            out = run_stage(spark, tmp_path, k, docs)
            assert out.columns == docs.columns
            got = sorted(map(key, out.collect()))
            if k == 0:
                assert got == sorted(repr(r[:2]) for r in rows if r[1])
            if k in (1, 3):
                assert got == want
            if k == 2:
                # One row for each id; without an id one for each text that no id has; empty texts as they are.
                ids = sorted((r.doc_id for r in out.collect() if r.doc_id is not None))
                assert ids == sorted({r[0] for r in rows if r[0] is not None} - {6})
                assert sorted(repr(r.text) for r in out.collect() if r.doc_id is None) == sorted(map(repr, [nameless, rows[5][1], None]))
            if clash:
                assert all(r[c] == "x" for r in out.collect() for c in clash)
        mixed = run_stage(spark, tmp_path, 4, docs)
        names = ["mix_" + c if clash else c for c in ("size", "source_size", "target", "copies", "taken")]
        assert mixed.columns == [*docs.columns, *names]
        out = mixed.collect()
        from collections import Counter

        have, got = Counter(map(repr, (r[:2] for r in rows))), Counter(map(key, out))
        assert all(got[x] <= have[x] for x in got) and len(got) > 8
        for s in ("a", "b", None):
            own = [r for r in out if r.source == s]
            words = sum(len((r[1] or "").split()) for r in rows if r[3] == s)
            assert all(r[names[3]] in (1, 2) and r[names[4]] == r[names[3]] * len((r.text or "").split()) for r in own)
            assert all(r[names[1]] == words for r in own)
            assert abs(sum(r[names[4]] for r in own) - own[0][names[2]]) <= 60 or s == "b"


def test_equal_rows_share_their_copies(spark, tmp_path, monkeypatch):
    from helixframe.llm import mixing

    rows = [(7, "one two three", "en", "a")] * 501 + [(i, "four five", "en", "a") for i in range(100, 200)] + [(i, "six " * 9, "en", "b") for i in range(200, 260)] + [(1, "x y", "en", "c")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(7)
    plain = sorted((r.doc_id, r.copies) for r in mixing.mix(docs).collect())
    for hot, chunk in ((100_000, 10_000), (50, 40)):
        monkeypatch.setattr(mixing, "HOT", hot)
        monkeypatch.setattr(mixing, "CHUNK", chunk)
        assert sorted((r.doc_id, r.copies) for r in mixing.mix(docs.repartition(3)).collect()) == plain
        got = mixing.mix_rows(docs.repartition(2)).collect()
        assert sorted((r.doc_id, r.copies) for r in got) == plain and len(got) == len(rows)
    own = [r for r in got if r.source == "a"]
    assert {r.copies for r in own if r.doc_id == 7} <= {0, 1, 2} and abs(sum(r.taken for r in own) - own[0].target) <= 5


def test_empty_tables(spark, tmp_path):
    tables(spark, tmp_path)
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for k in range(5):
        out = run_stage(spark, tmp_path, k, docs)
        assert out.count() == 0 and out.columns[: len(docs.columns)] == docs.columns
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert p.run(spark, str(tmp_path)).count() == 0
