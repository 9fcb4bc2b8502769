"""Decontamination: names wherever they stand, hot windows, null and repeated ids, against the SQL where that holds."""

import random

from helixframe.llm import decontam
from helixframe.llm.queries import ORACLES

from .test_sql import same

ITEM = "Alice sold 12 clips to her friends in April. Alice then sold 3 more clips in May. Tom lost 3 of them. How many clips did Alice and Tom have left?"


def asked(*names):
    out = ITEM
    for old, new in zip(("Alice", "Tom"), names):
        out = out.replace(old, new)
    return out


TEXTS = [
    ITEM,
    asked("Berta", "Kim"),
    "Question: " + asked("Berta", "Kim"),
    'He said "' + asked("McKay", "DuPont") + '" and left.',
    "(" + asked("IBM", "HP") + ")",
    asked("Berta", "Kim").replace(" ", "   ").replace("12", "40"),
    "Title\n\n" + ITEM.replace("Alice then", "Berta then"),  # one name stands for two
    ITEM.replace("clips", "coins"),
    "READ THIS ALOUD: " + ITEM,
    "Alice met Tom in April and May.",
    None,
    "",
]


def test_names_anywhere(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, ITEM), (2, "The NASA probe and the ESA probe met over the far side of the moon in June")], "item_id long, text string")
    rows = same(decontam.query(docs, bench), ORACLES["op1_benchmark_decontamination"], documents=docs, benchmark=bench)
    # Columns in order: coverage, doc_id, item_id, item_windows, matched_windows, reparameterised.
    assert {(r[1], r[5]) for r in rows} == {(0, False), (1, True), (2, True), (3, True), (4, True), (5, True), (8, False)}
    assert all(r[0] == 1 for r in rows if r[1] in (0, 1, 2, 3, 4, 5))


def test_a_short_item_whatever_stands_before(spark):
    item = "What is the name of our capital town?"
    leads = ["", "Question: ", "Q1, ", "so ", "Note; ", 'He asked "', "word\n", "THE END. ", "IBM "]
    docs = spark.createDataFrame([(i, lead + item + " Yes.") for i, lead in enumerate(leads)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted((r.doc_id, r.coverage) for r in decontam.query(docs, bench).collect()) == [(i, 1.0) for i in range(len(leads))]


def test_tokens(spark):
    got = spark.createDataFrame([("The McKay IBM saw READ THIS ALOUD Über 12km 3.50 é\u0002\u0004x Ö",)], "text string").select(decontam.tokens(decontam.F.col("text"))).first()[0]
    assert got == ["the", "\u0002mckay", "\u0002ibm", "saw", "read", "this", "aloud", "\u0002über", "\u000312", "km", "\u00033.50", "é", "x", "ö"]


def test_shuffled_benchmark_and_hot_windows(spark, monkeypatch):
    rng = random.Random(1)
    word = lambda: f"w{rng.choice('abcdefgh')}{rng.choice('stuvw')}"
    items = [(i, " ".join(word() for _ in range(rng.choice([5, 8, 20, 40])))) for i in range(30)]
    rows = [(i, items[0][1]) for i in range(300)] + [(1000 + i, " ".join(word() for _ in range(30)) + " " + rng.choice(items)[1]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    bench = spark.createDataFrame(items, "item_id long, text string")
    plain = sorted(decontam.query(docs, bench).collect())
    assert len(plain) >= 360
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    assert sorted(decontam.query(docs, bench).collect()) == plain


def test_null_repeated_ids_and_long_texts(spark):
    item = "the quick lazy fox jumps over some very old brown dogs near that river"
    half = item.split()
    long_ = "some words that say nothing of it " * 30_000
    rows = [(None, item), (None, "nothing"), (None, " ".join(half[:8])), (1, item), (1, item), (1, "other"), (2, " ".join(half[:8])), (2, " ".join(half[6:])), (3, long_ + item + " " + long_), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = sorted(((r.doc_id, round(r.coverage, 2)) for r in decontam.query(docs, bench).collect()), key=repr)
    # Halves of one id aren't put together.
    assert got == [(1, 1.0), (3, 1.0), (None, 1.0)]
    empty = bench.where("false")
    assert decontam.query(docs, empty).count() == decontam.query(docs.where("false"), bench).count() == 0
