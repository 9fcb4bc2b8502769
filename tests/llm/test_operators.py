"""The operators over small tables: brute force, nulls, empty and repeated rows, ties, extra columns with clashing names."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from helixframe.llm import decontam, html_text, langid, licenses, media, mixing, neardup, quality, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, source string"
#: Names that the operators use for themselves.
CLASH = ["score", "predicted", "size", "rep", "key", "h", "id", "component_id", "taken", "copies", "votes", "path", "license", "hub", "n"]


def docs_of(spark, rows, clash=True):
    df = spark.createDataFrame([(*r, None, None)[:4] for r in rows], SCHEMA)
    return df.withColumns({c: F.lit("x") for c in CLASH}) if clash else df


WORDS = ["alpha", "beta", "gamma", "delta", "house", "tree", "river", "stone", "cloud", "light"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))


EDGES = [(1, None, "en", "a"), (2, "", "en", None), (3, "  \n", None, "a"), (4, "word", "en", "b"), (5, "word", "en", "b"), (5, "word", "en", "b"), (None, "two words", "en", "b"), (9, "123 ... !!", "de", "c"), (10, "Ünïcode " * 9000, "de", "c")]


@pytest.fixture(scope="module")
def edges(spark):
    return docs_of(spark, EDGES).cache()


def empty(df):
    return df.where("false")


def component_of(rows):
    sets, above = {}, {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        k = min(5, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
        above[i] = i

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                c = len(sets[a] & sets[b])
                if 100 * c >= 85 * (len(sets[a]) + len(sets[b]) - c):
                    x, y = sorted((top(a), top(b)))
                    above[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


def test_near_duplicates_equal_brute_force(spark):
    rng, rows = random.Random(11), []
    for _ in range(12):
        base = prose(rng, rng.randint(8, 120)).split()
        for _ in range(rng.randint(1, 14)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(WORDS) + "z" + str(rng.randrange(9))
            rows.append((len(rows) * 3 + 1, " ".join(w) if rng.random() < 0.8 else " ".join(w).upper()))
    rows += [(1000, None), (1001, ""), (1002, "a b"), (1003, "A  b"), (1004, "a b c")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.query(docs_of(spark, rows)).collect()}
    assert got == component_of(rows)


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    """Buckets that are dealt out in several blocks lose nothing."""
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 7)
    rng = random.Random(5)
    base, rows = prose(rng, 60).split(), []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(50)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.query(docs_of(spark, rows)).collect()}
    assert got == component_of(rows)


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(i, i + 1) for i in range(100, 160)]
    got = {r.id: r.component for r in neardup.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    above = {}

    def top(x):
        above.setdefault(x, x)
        while above[x] != x:
            x = above[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = sorted((top(a), top(b)))
            above[y] = x
    assert got == {x: top(x) for x in above}


ITEMS = [(1, "Anna has 12 apples and gives 5 of them to her friend Bob who eats 5 apples a day"), (2, "The quick brown fox jumps over the lazy dog near the old mill"), (3, None), (4, ""), (5, "short one")]


def test_decontamination(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    lead = "Some words before it all begins. "
    docs = docs_of(
        spark,
        [
            (1, lead + ITEMS[0][1] + ". And after."),
            (2, lead + "Carla has 30 apples and gives 7 of them to her friend Dave who eats 7 apples a day."),
            (3, lead + "Carla has 30 apples and gives 7 of them to her friend Dave who eats 9 apples a day."),
            (4, "THE QUICK BROWN FOX JUMPS OVER THE LAZY DOG NEAR THE OLD MILL"),
            (5, "the quick brown fox went home"),
            (6, None),
            (7, ""),
            (8, "short one"),
            (9, (lead + ITEMS[1][1] + " ") * 40),
        ],
    )
    got = {(r.doc_id, r.item_id): r.reparameterised for r in decontam.matches(docs, bench).collect()}
    assert got == {(1, 1): False, (2, 1): True, (4, 2): False, (9, 2): False, (8, 5): False}
    assert sorted(r.doc_id for r in decontam.clean(docs, bench).collect()) == [3, 5, 6, 7]
    assert decontam.matches(docs, empty(bench)).count() == decontam.matches(empty(docs), bench).count() == 0


def test_media_columns(spark, edges):
    rows = media.media_digest(edges).collect()
    assert len(rows) == len(EDGES)
    by = {(r.doc_id, r.n_bytes): r for r in rows}
    for i, text, *_ in EDGES:
        data = (text or "").encode()
        r, payload = by[i, len(data)], media.padded(data)
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        stored = media.write_wav(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
    full = media.with_media(edges.where("doc_id = 4")).first()
    assert bytes(full.payload) == media.padded(b"word") and len(full.times) == len(full.hashes)
    assert media.media_digest(empty(edges)).count() == 0


def test_licenses(spark):
    apache, mit = "Licensed under the Apache License, Version 2.0.", "Released under the MIT License."
    rows = [
        (1, "a/LICENSE", apache), (2, "a/b/x.txt", "text"), (3, "a/b/c/COPYING.md", "Intro\n" + mit), (4, "a/b/c/d/y.txt", None), (5, "a/b/z.txt", "prose\n" + mit + "\nmore"), (6, "q/y.txt", "the license of the house"),
        (7, None, ""), (8, "a/c/d/e/f.txt", ""), (9, "a/b/c/d/y.txt", "x"), (10, "license/y", "no"),
    ]
    files = spark.createDataFrame(rows, "k long, path string, text string").withColumns({c: F.lit(1) for c in ("key", "license", "score", "dir", "up")})
    got = {r.k: (r.license, r.origin, r.license_dir) for r in licenses.scan(files, "k").collect()}
    assert got[1][:2] == ("Apache-2.0", "header") and got[5][:2] == ("MIT", "header") and got[3][:2] == ("MIT", "header")
    assert got[2] == ("Apache-2.0", "inherited", "a") and got[4] == got[9] == ("MIT", "inherited", "a/b/c") and got[8] == ("Apache-2.0", "inherited", "a")
    assert got[6] == got[7] == got[10] == (None, None, None)
    assert licenses.scan(empty(files), "k").count() == 0


def cosine(text, templates=licenses.TEMPLATES):
    """Best licence of a text by plain loops."""
    idf, vectors, other = licenses._model(templates)
    plain = "\n".join(re.sub(licenses.COMMENT, "", x) for x in text.lower().split("\n"))
    units = re.split(r"\n", plain) + re.split(r"\n\s*\n", plain)
    units += [x for u in units for x in re.split(r"(?<=[.!?])\s+", u)]
    best = (-9, 0.0, None)
    for unit in set(units):
        tf = {}
        for w in re.findall("[a-z0-9]+", unit):
            if w not in licenses.STOP:
                tf[w] = tf.get(w, 0) + 1
        norm = sum((c * idf.get(w, other)) ** 2 for w, c in tf.items()) ** 0.5
        bar = licenses.LEAST if len(tf) > 2 else licenses.LEAST_OF_TWO if len(tf) == 2 else 2
        for t, v in zip(templates, vectors):
            s = round(sum(c * idf[w] * v[w] for w, c in tf.items() if w in v) / norm, 6) if norm else 0
            if s >= bar and (licenses.rank(t), s, [-ord(x) for x in t[0]]) > (*best[:2], [-ord(x) for x in best[2] or "~"]):
                best = (licenses.rank(t), s, t[0])
    return best[1:]


def test_license_scores_equal_brute_force(spark):
    rng, rows = random.Random(3), []
    for i in range(80):
        lines = [prose(rng, 6)]
        w = rng.choice(licenses.TEMPLATES)[1].split()
        for _ in range(rng.randrange(4)):
            w.insert(rng.randrange(len(w)), rng.choice(WORDS + ["license", "software"]))
        lines.insert(rng.randrange(2), " ".join(w))
        if i % 3 == 0:
            lines = ["# " + x for x in lines] + ["#", "", prose(rng, 9)]
        if i % 5 == 0:
            lines.append("All rights reserved. " + prose(rng, 3))
        rows.append((i, "\n".join(lines)))
    got = {r.key: (r.score, r.license) for r in licenses.own_licenses(spark.createDataFrame(rows, "key long, text string")).collect()}
    for i, text in rows:
        score, name = cosine(text)
        assert (name is None and i not in got) or (got[i][1] == name and abs(got[i][0] - score) < 2e-6)


def test_mixing(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LANDING", 8)
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randint(1, 60)), None, rng.choice(["a", "b", "b", "c", None, "dd"])) for i in range(900)] + [(900, None, None, "e"), (901, "", None, "e")]
    docs = docs_of(spark, rows)
    for block in (4000, 40):
        out = mixing.mix(docs, block=block).collect()
        assert len(out) == len(rows)
        size = {}
        for i, t, _, s in rows:
            size[s] = size.get(s, 0) + len((t or "").split())
        names = sorted(s for s in size if s is not None) + [None]
        weight, rest, want, open_ = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, 1.5 * sum(size.values()), {}, set(names)
        while open_:
            t = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
            over = [s for s in open_ if t[s] > 2 * size[s]]
            if not over:
                want |= t
                break
            for s in over:
                want[s] = 2 * size[s]
                rest -= want[s]
                open_.remove(s)
        for s in names:
            own = [r for r in out if r.source == s]
            assert all(abs(r.target - want[s]) < 1e-6 * max(1, want[s]) and r.source_size == size[s] and r.taken <= 2 * r["size"] for r in own)
            assert abs(sum(r.taken for r in own) - want[s]) <= 80
        again = mixing.mix(docs.repartition(3), block=block).collect()
        assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in out)
    assert mixing.mix(empty(docs)).count() == 0


def test_mixing_edges(edges):
    out = mixing.mix(edges).collect()
    assert len(out) == len(EDGES) and {r.doc_id for r in out} == {e[0] for e in EDGES}


def test_toxicity(spark, edges):
    rng = random.Random(6)
    rows = [(i, prose(rng, 30) + (" stupid idiot" if i % 4 == 0 else ""), "en", "s") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    out = toxicity.query(docs_of(spark, rows), labels).collect()
    assert len(out) == 400 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in out) >= 396 and all(0 <= r.score <= 1 for r in out)
    assert toxicity.query(edges, labels).count() == len(EDGES)
    assert toxicity.query(edges, empty(labels)).where("predicted = 1").count() == 0


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a b</p>"), (1, "u", "<p>a b</p>"), (2, None, None), (None, "u", "")], "page_id long, url string, html string").withColumns({"text": F.lit(1), "id": F.lit(2)})
    got = sorted(((r.page_id or 0, r.url, r.text, r.n_chars) for r in html_text.main_text(pages).collect()), key=str)
    assert got == [(0, "u", "", 0), (1, "u", "a b", 3), (1, "u", "a b", 3), (2, None, "", 0)]
    assert html_text.main_text(empty(pages)).count() == 0


def test_quality(spark, edges):
    out, fitted = quality.classify(edges)
    assert out.count() == len(EDGES) and out.where("score between 0 and 1 and posterior between 0 and 1").count() == len(EDGES)
    assert quality.query(empty(edges)).count() == 0


def test_language(spark, edges):
    words = {"en": "the house with thing ", "de": "der schön und nicht "}
    docs = docs_of(spark, [(i, words[g] * (1 + i % 9), g, "s") for i, g in enumerate(["en", "de"] * 60)])
    out = langid.query(docs).collect()
    lang = {i: g for i, g in enumerate(["en", "de"] * 60)}
    assert sum(r.lang_pred == lang[r.doc_id] for r in out) >= 118 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    got = {r.doc_id: r.lang_pred for r in langid.query(edges).collect()}
    assert got[1] == got[2] == got[3] == got[9] == "und" and got[10] != "und"
    assert langid.query(empty(edges)).count() == 0


URLS = [
    "https://www.example.com/en/1", "http://Blog.Example.COM/en/", "http://example.com/fr/", "x://net/es/a?b", "https://a.net/fr", "https://a.net/fr/x#y", "http://spam-farm.example.org/", "http://a.spam-farm.example.org/x",
    "http://www.cheap-pills.example.com/fr/", "http://com", "no url", None, "", "http://", "a://b://c/d", "http://x.org/p?q://r", "http://net/es/", "http://xnet/es/", "http://example.com/EN/",
]


def plain_verdict(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    return host, path, None, "block" if any(host == b or host.endswith("." + b) for b in url_filter.BLOCKED_HOSTS) else "allow"


def test_urls(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumns({"host": F.lit(1), "id": F.lit(1)})
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages).collect()}
    assert got == {i: plain_verdict(u) for i, u in enumerate(URLS)}
    assert url_filter.judge(empty(pages)).count() == 0
