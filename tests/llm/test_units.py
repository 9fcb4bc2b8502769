"""The operators' kernels against brute force, round trips and small fixtures; no Spark."""

import hashlib
import random
import wave
import io
import zlib

import numpy as np

from helixframe.llm import html_text, langid, licenses, media, mixing, neardup, quality, toxicity, url_filter


def test_media_round_trip():
    for data in (b"", b"a", "é€😀".encode(), bytes(range(256)) * 9, b"x" * 576, b"y" * 577):
        payload = media.padded(data)
        assert len(payload) % 576 == 0 and len(payload) >= 576 and payload.startswith(data) and set(payload[len(data) :]) <= {255}
        stored = media.write_wav(payload)
        assert media.read_wav(stored) == (payload, media.RATE)
        with wave.open(io.BytesIO(stored)) as w:
            assert w.getsampwidth() == 1 and w.getnframes() == len(payload)
        t, h = media.fingerprint(payload)
        assert len(t) == len(h) and (np.diff(t) >= 0).all()
    a, b = media.fingerprint(media.padded(b"hello world " * 200)), media.fingerprint(media.padded(b"hello there " * 200))
    assert len(a[0]) and not (len(a[1]) == len(b[1]) and (a[1] == b[1]).all())


def test_spectra_come_in_chunks(monkeypatch):
    data = media.padded(bytes(random.Random(2).randrange(256) for _ in range(30_000)))
    whole = media.fingerprint(data)
    monkeypatch.setattr(media, "CHUNK", 7)
    part = media.fingerprint(data)
    assert all((x == y).all() for x, y in zip(whole, part))


def test_peaks_find_a_tone():
    n = np.arange(576 * 4)
    tone = (128 + 100 * np.sin(2 * np.pi * 40 * n / 576)).astype(np.uint8).tobytes()
    assert (np.concatenate([media.peaks(m) for m in media.spectra(tone)]) == 40).any(axis=1).all()


def brute_words(text):
    return (text or "").lower().split()


def test_shingles():
    assert len(neardup.shingles(None)) == len(neardup.shingles(" \n\t")) == 0
    assert len(neardup.shingles("a b")) == 1 and (neardup.shingles("A b") == neardup.shingles("a B ")).all()
    assert len(neardup.shingles("a b c d e f a b c d e")) == 7 - 1
    assert len(neardup.shingles("É x")) == 1 and (neardup.shingles("É x") != neardup.shingles("é x")).all()
    assert (neardup.shingles("a b c d") != neardup.shingles("b c d a")).any()


def test_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    for size in (1, 3, 40, 2000):
        both = neardup._mix(rng.integers(0, 2**63, size * 2).astype(np.uint64))
        a, b = both[: int(size * 1.9) or 1], both[int(size * 0.1) :]
        real = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((neardup.signature(a) == neardup.signature(b)).mean() - real) < 0.2
    assert not (neardup.signature(both[:1]) == neardup._NONE).any()


def test_flight_keeps_the_totals():
    rng = np.random.default_rng(4)
    size = rng.integers(1, 5000, 700).astype(float)
    p = np.full(700, 0.37)
    q = mixing.flight(p, size, [(int(i), i) for i in range(700)])
    assert ((q > 0) & (q < 1)).sum() <= 2 and abs(q.sum() - p.sum()) < 1e-6 and abs(q @ size - p @ size) < 1e-3
    done = mixing.land(q, size)
    assert set(done) <= {0.0, 1.0} and abs(done @ size - p @ size) <= 5000
    same = mixing.flight(np.full(9, 0.5), np.ones(9), [(i, i) for i in range(9)])
    assert ((same > 0) & (same < 1)).sum() <= 2
    assert len(mixing.flight(np.zeros(0), np.zeros(0), [])) == 0 and len(mixing.land(np.zeros(0), np.zeros(0))) == 0


def test_counterfactual_penalty_lowers_the_scores_of_neutral_mentions():
    cache = {}
    toxic = [f"those {g} are stupid idiots x{i}" for i, g in enumerate(["muslims"] * 30)]
    clean = [f"the {g} opened a shop today y{i}" for i, g in enumerate(["christians"] * 30)]
    feats = [toxicity.features(toxicity.words_of(t), cache) for t in toxic + clean]
    labels = [1] * 30 + [0] * 30
    pairs = []
    for t, f in zip(toxic + clean, feats):
        for c in toxicity.counterfactuals(toxicity.words_of(t)):
            pairs.append((f, toxicity.features(c, cache)))
    assert pairs
    neutral = toxicity.words_of("muslims opened a library")
    plain, fair = (toxicity.train(feats, labels, pairs, w) for w in (0.0, 20.0))
    assert fair.score_words(neutral, {}) < plain.score_words(neutral, {})
    assert fair.score_words(toxicity.words_of("stupid idiots"), {}) > 0 > fair.score_words(neutral, {})


def test_toxicity_edges():
    assert toxicity.train([], []).score_words(set(), {}) < -10
    one = toxicity.train([toxicity.features({"a"}, {})], [1])
    assert one.score_words({"b"}, {}) > 10
    assert toxicity.words_of(None) == set()


def test_quality():
    rng = random.Random(5)
    small, large = "the of in to on and was it is by a".split(), [f"{a}{b}" for a in ("house", "river", "people", "kind", "garden") for b in ("s", "ed", "ing", "ly", "est", "ward")]
    good = [" ".join(rng.choice(small) if rng.random() < 0.4 else rng.choice(large) for _ in range(rng.randint(30, 90))).capitalize() + "." for _ in range(60)]
    poor = ["$$$ &&& %%% ### " * 20, "BUY!! NOW!! " * 30, "spam spam spam spam " * 30, "a | b | c | d | " * 30] * 8
    texts = good + poor
    words = quality.Words()
    r = [quality.ratios(t) for t in texts]
    v = np.array([quality.votes(x) for x in r])
    patterns, counts = np.unique(v, axis=0, return_counts=True)
    model = quality.expectation_maximisation(patterns, counts.astype(float))
    q = model.posterior(v)
    assert (q[:60] > 0.5).all() and (q[60:] < 0.5).mean() > 0.7
    w = quality.train([quality.hashed(quality.looked_at(t, words)[1], x) for t, x in zip(texts, r)], q)
    s = [quality.score_of(w, *quality.hashed(quality.looked_at(t, words)[1], x)) for t, x in zip(texts, r)]
    assert np.mean([(a >= 0.5) == (b >= 0.5) for a, b in zip(s, q)]) > 0.95
    assert len(quality.votes(quality.ratios(None))) == len(quality.votes(r[0]))


def test_em_finds_accuracies():
    rng = np.random.default_rng(8)
    y = rng.random(8000) < 0.7
    acc = np.array([0.95, 0.8, 0.7, 0.9, 0.6])
    v = np.where(rng.random((8000, 5)) < acc, y[:, None], ~y[:, None]).astype(int)
    v[rng.random((8000, 5)) < 0.3] = -1
    patterns, counts = np.unique(v, axis=0, return_counts=True)
    model = quality.expectation_maximisation(patterns, counts.astype(float))
    assert np.abs(model.accuracies() - acc).max() < 0.05 and abs(model.prior - 0.7) < 0.05


def test_language():
    rng = random.Random(1)
    words = {"en": ["the", "house", "with", "thing"], "de": ["der", "schön", "und", "nicht"], "fr": ["où", "été", "que", "leaux"]}
    make = lambda g, n: " ".join(rng.choice(words[g]) for _ in range(n))
    texts, langs = zip(*[(make(g, 60), g) for g in words for _ in range(30)])
    taught = [(w, g) for t, g in zip(texts, langs) for w in langid.teaching_windows(t)]
    net = langid.train(*map(list, zip(*taught)), steps=150)
    test = [(make(g, n), g) for g in words for n in (3, 40, 900)]
    names, scores = langid.classify(net, [t for t, _ in test])
    assert np.mean([a == b for a, (_, b) in zip(names, test)]) > 0.85 and all(0 <= s <= 1 for s in scores)
    assert langid.classify(net, [None, "", "123 !", "été"])[0][:3] == ["und"] * 3
    assert langid.classify(langid.train([], []), ["abc"]) == (["und"], [0.0])
    assert langid.classify(langid.train([b"abc"], ["en"]), ["abc"])[0] == ["en"]
    whole = langid.classify(net, [t for t, _ in test])
    alone = [langid.classify(net, [t]) for t, _ in test]
    assert whole[0] == [a[0][0] for a in alone]


def test_digest_array(tmp_path, monkeypatch):
    names = [f"host{i}.example" for i in range(500)] + ["é.example", ""]
    path = tmp_path / "a.uda"
    path.write_bytes(url_filter.build(names + names[:3]))
    array = url_filter.DigestArray(str(path))
    assert len(array.keys) == len(names) and (np.diff(array.keys.astype(object)) > 0).all()
    probe = [n.encode() for n in names] + [b"nothost", b"host1.exampl"]
    assert array.contains(probe).tolist() == [True] * len(names) + [False, False]
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda b: 7)
    path.write_bytes(url_filter.build(names))
    clash = url_filter.DigestArray(str(path))
    assert clash.contains(probe).tolist() == [True] * len(names) + [False, False]
    path.write_bytes(url_filter.build([]))
    assert not url_filter.DigestArray(str(path)).contains([b"a"]).any()


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies and ask you to accept them all, please do so now.</p></div>
<main><div class="post"><h1>A title &amp; more</h1><p>First paragraph with <a href="x">a link</a>, some &lt;text&gt;
and&nbsp;more.<p>Second paragraph, unclosed <b>bold<br>line</p><ul><li>one<li>two</ul><div class="ad">Buy!</div>
<blockquote>Quoted words of somebody.</blockquote></div><aside>Aside text, quite long, about other things.</aside></main>
<section id="comments"><p>Great article, I loved each of its words and more.</p></section>
<form><p>Sign up</p></form><footer>&copy; all</footer></body></html>"""


def test_html():
    assert html_text.extract(PAGE).split("\n\n") == [
        "A title & more", "First paragraph with a link, some <text> and more.", "Second paragraph, unclosed bold line", "one", "two", "Quoted words of somebody.",
    ]
    assert html_text.extract(None) == html_text.extract("") == html_text.extract("<p></p>") == ""
    assert html_text.extract("just text") == "just text" and html_text.extract("a < b &amp") == "a < b &"
    assert html_text.extract("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert html_text.extract('<p title="a>b">x<!-- <p>no</p> -->y<script>z') == "xy"


def test_anchors_are_needed():
    anchors = set(licenses.anchors())
    _, vectors, _ = licenses._model(licenses.TEMPLATES)
    for v in vectors:
        assert sum(x * x for w, x in v.items() if w not in anchors) < licenses.LEAST**2


def test_crc_is_the_usual_one():
    assert zlib.crc32(b"12") % 5 in range(5) and len(hashlib.sha256(b"").hexdigest()) == 64
