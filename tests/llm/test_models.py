"""Scores of the trained operators against plain loops over their definitions; edges of their queries."""

import itertools
import math
import random
import unicodedata
import zlib

import numpy as np
from pyspark.sql import functions as F

from helixframe.llm import langid, media, quality, toxicity

TEXTS = [None, "", " \n ", "a", "A a A b", "spam spam spam spam!", "x | y | z\n\nx | y | z\nline", "Ünïcode Ärger, ñandú... $$$ %%%", "One two. One two! One two?", "word " * 300, "a b c", "𝒳 😀 é"]


def plain_ratios(text):
    text = text or ""
    run = text.split()
    n = len(run)
    if not n:
        return [0.0] * 12
    cat = [unicodedata.category(c) for c in text]
    bare = [w.lower().strip(".,;:!?") for w in run]
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        sum(not (k[0] in "LMN" or c.isspace() or c in ".,;:!?'\"()-") for c, k in zip(text, cat)) / len(text),
        cat.count("Lu") / max(1, sum(k[0] == "L" for k in cat)),
        len(set(bare)) / n,
        max(bare.count(b) for b in bare) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        sum(len(b) <= 3 for b in bare) / n,
        text.count("|") / n,
        min(1.0, math.log1p(n) / 8),
        sum(a == b for a, b in zip(run, run[1:])) / n,
        text.count("!") / n,
        min(20, max(len(list(g)) for _, g in itertools.groupby(run))) / 20,
        len(set(zip(run, run[1:]))) / max(1, n - 1),
    ]


def test_ratios_by_definition(monkeypatch):
    rng = random.Random(1)
    words = ["the", "The", "house", "!!", "|", "$$", "Aa.", "aa", "é", "RUN", "run."]
    texts = TEXTS + ["".join(rng.choice(words) + rng.choice([" ", " ", "\n"]) for _ in range(rng.randint(1, 80))) for _ in range(60)]
    memory = quality.Words()
    for t in texts:
        assert np.allclose(quality.looked_at(t, memory)[0], plain_ratios(t)) and np.allclose(quality.ratios(t), plain_ratios(t)), t
    monkeypatch.setattr(quality.Words, "FULL", 3)
    for t in texts:
        assert np.allclose(quality.looked_at(t, memory)[0], plain_ratios(t))


def test_hashed_features_and_scores_by_definition():
    rng = np.random.default_rng(2)
    w = rng.normal(size=quality.SIZE + 1)
    memory = quality.Words()
    for t in TEXTS[3:]:
        r, known = quality.looked_at(t, memory)
        bins, values = quality.hashed(known, r)
        run = t.split()
        want = {}
        for x in run:
            shape = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in x[:2] + x[-3:])
            for b in (quality._bin("w" + x.lower().strip(".,;:!?")), quality._bin("s" + shape), quality._bin(f"n{min(len(x), 20)}")):
                want[b] = want.get(b, 0) + 1 / len(run)
        z = w[-1] + sum(w[b] * v for b, v in want.items())
        for k, x in enumerate(plain_ratios(t)):
            step = min(10, int(x * 20))
            z += w[(1 << quality.BITS) + 32 * k + step] + w[(1 << quality.BITS) + 32 * k + 16 + step // 3]
        assert (np.diff(bins) > 0).all()
        assert abs(quality.score_of(w, bins, values) - 1 / (1 + math.exp(-z))) < 1e-5


def test_expectation_maximisation_rises():
    """The rounds never lower the likelihood of the votes (but for the vote each way that keeps chances off 0 and 1)."""
    rng = np.random.default_rng(3)
    patterns = np.array(list(itertools.product([-1, 0, 1], repeat=4)))
    counts = rng.integers(0, 200, len(patterns)).astype(float)

    def likelihood(m):
        yes, no = patterns == 1, patterns == 0
        good = np.log(m.prior) + yes @ np.log(m.good) + no @ np.log(1 - m.good)
        poor = np.log(1 - m.prior) + yes @ np.log(m.poor) + no @ np.log(1 - m.poor)
        return counts @ np.logaddexp(good, poor)

    seen = []
    for rounds in (1, 2, 4, 8, 16, 64):
        quality_rounds, quality.EM_ROUNDS = quality.EM_ROUNDS, rounds
        seen.append(likelihood(quality.expectation_maximisation(patterns, counts)))
        quality.EM_ROUNDS = quality_rounds
    assert all(b >= a - 1 for a, b in zip(seen, seen[1:])) and seen[-1] > seen[0]


def test_toxicity_scores_by_definition():
    rng = random.Random(4)
    vocab = [a + b for a in ("stup", "idio", "hous", "gard", "mus") for b in ("id", "ts", "es", "en", "lims", "er")]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 12))) for _ in range(120)]
    cache = {}
    feats = [toxicity.features(toxicity.words_of(t), cache) for t in texts]
    y = [int("stupid" in t or "idiots" in t) for t in texts]
    model = toxicity.train(feats, y)
    memory = {}
    assert len(model.index) > 3
    for t, f in zip(texts, feats):
        plain = model.bias + sum(model.weights[model.index[int(k)]] for k in f if int(k) in model.index)
        assert abs(model.score_words(toxicity.words_of(t), memory) - plain) < 1e-9


def test_toxicity_draw_and_edges(spark):
    rows = [(i, ("stupid idiot " if i % 3 == 0 else "kind words ") + f"w{i}") for i in range(200)] + [(3, "stupid idiot again")] * 50 + [(None, "stupid idiot"), (None, None), (300, "x " * 200_000 + "stupid idiot")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"label": F.lit("x"), "toxic": F.lit(1), "score": F.lit("s")})
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)] * 3 + [(None, 1), (5, None)], "doc_id long, toxic int").withColumn("text", F.lit("no"))
    use = labels.select("doc_id", F.col("toxic").alias("label"))
    for most in (10, 500):
        drawn = toxicity.drawn(use, most).collect()
        assert len(drawn) == len(set(drawn)) and sum(r.label == 1 for r in drawn) == min(most, 67) and sum(r.label == 0 for r in drawn) == min(most, 133)
        assert sorted(drawn) == sorted(toxicity.drawn(use.repartition(5), most).collect())
    out = toxicity.query(docs, labels).collect()
    assert len(out) == len(rows)
    assert all(r.predicted == int(r.score >= 0.5) for r in out)
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    by = {r.doc_id: r.predicted for r in out if r.doc_id is not None}
    assert all(by[i] == int(i % 3 == 0) for i in range(200)) and by[300] == 1
    assert toxicity.query(docs.where("false"), labels).count() == 0


def test_network_by_definition():
    rng = random.Random(6)
    words = {"en": "the house with thing ", "de": "der schön und nicht ", "fr": "où été que leaux "}
    taught = [(w, g) for g, t in words.items() for i in range(9) for w in langid.teaching_windows(t * (i + 1))]
    net = langid.train(*map(list, zip(*taught)), steps=60)
    widest = max(langid.WIDTHS)

    def plain(text):
        data = text.encode()
        total, weight = np.zeros(len(net.langs)), 0.0
        for at in range(0, max(1, len(data)), langid.WINDOW):
            part = data[at : at + langid.WINDOW]
            x = net.emb[np.frombuffer(part.ljust(langid.WINDOW + widest - 1, b"\0"), np.uint8)].reshape(-1)
            h = np.array([max(x[p * langid.DIM : (p + widest) * langid.DIM] @ net.conv[:, f] for p in range(langid.WINDOW)) for f in range(net.conv.shape[1])]) + net.bias
            z = np.maximum(h, 0) @ net.out + net.out_bias
            total += (z - np.log(np.exp(z - z.max()).sum()) - z.max()) * max(1, len(part))
            weight += max(1, len(part))
        p = np.exp(total / weight - (total / weight).max())
        return p / p.sum()

    texts = ["".join(rng.choice(list(words.values())) for _ in range(k)) for k in (1, 3, 9, 40)] + ["é"]
    names, scores = langid.classify(net, texts)
    for t, name, s in zip(texts, names, scores):
        p = plain(t)
        assert net.langs[int(p.argmax())] == name and abs(p.max() - s) < 1e-4


def test_every_language_teaches(spark, monkeypatch):
    """More languages than rows are allowed: one row of each teaches still; repeated rows teach once, long texts from all over."""
    monkeypatch.setattr(langid, "TRAIN_ROWS", 5)
    rows = [(i % 7, f"words of language {i % 9} " * 20, f"l{i % 9}") for i in range(400)] + [(1, "hot " * 40, "hot")] * 300 + [(2, None, "none"), (3, "no lang", None), (None, "null id " * 9, "l0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    w, g = langid.training_windows(docs, "doc_id", "text", "lang")
    assert set(g) == {f"l{i}" for i in range(9)} | {"hot"} and len(w) == len(g) == 10 * langid.ROW_WINDOWS
    again = langid.training_windows(docs.repartition(7), "doc_id", "text", "lang")
    assert (w, g) == again
    parts = langid.teaching_windows("".join(chr(97 + i // 1000) for i in range(20_000)))
    assert len({p[:1] for p in parts}) > 3 and all(8 <= len(p) <= langid.WINDOW for p in parts)
    assert langid.teaching_windows("ab") == [b"ab"] * langid.ROW_WINDOWS


def test_held_out_of_null_ids(spark):
    docs = spark.createDataFrame([(None, "the house"), (4, "the house"), (4, "the house")], "doc_id long, text string").withColumns({"lang": F.lit("en"), "score": F.lit(1), "lang_pred": F.lit("x")})
    out = langid.query(docs).collect()
    assert sorted((r.doc_id or 0, r.held_out, r.lang_pred) for r in out)[0] == (0, True, "en" if any(not r.held_out for r in out) else "und")


def test_quality_draw(spark, monkeypatch):
    monkeypatch.setattr(quality, "TRAIN_ROWS", 20)
    rows = [(i, "some words of a text that is like others " * (1 + i % 5)) for i in range(200)] + [(7, "hot row")] * 300 + [(None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"votes": F.lit(1), "keep": F.lit(2)})
    one, two = (quality.classify(d) for d in (docs, docs.repartition(6)))
    assert one[0].count() == len(rows) and np.allclose(one[1].weights, two[1].weights)
    same = {(r.doc_id, r.score) for r in one[0].collect() if r.doc_id == 7 and len(r.votes)}
    assert len(same) == 2  # the row of its own and the repeated ones


def peaks_by_definition(samples):
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    out = []
    for at in range(0, len(x) - media.BLOCK + 1, media.HOP):
        frame = x[at : at + media.BLOCK].astype(np.float32) * media._WINDOW
        m = np.abs(np.fft.rfft(frame[None], axis=1)).astype(np.float32)[0]
        top = [k for k in range(1, len(m) - 1) if m[k] > m[k - 1] and m[k] >= m[k + 1]]
        out.append(sorted(sorted(top, key=lambda k: (-np.rint(np.float64(m[k]) * 100), k))[: media.PEAKS]))
    return out


def test_fingerprint_by_definition():
    rng = np.random.default_rng(7)
    for data in (b"", b"x" * 5000, bytes(rng.integers(0, 256, 4000, dtype=np.uint8)), (b"\x00" * 8 + b"\xff" * 8) * 400, "Ein Text mit Wörtern. ".encode() * 120):
        samples = media.padded(data)
        rows = peaks_by_definition(samples)
        want = sorted((t, a << 20 | b << 8 | gap) for gap in range(1, media.FAN + 1) for t in range(len(rows) - gap) for a in rows[t] for b in rows[t + gap])
        t, h = media.fingerprint(samples)
        assert list(zip(t.tolist(), h.tolist())) == want
