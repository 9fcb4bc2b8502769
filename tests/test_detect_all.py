"""Contaminant detection against brute force: all reads, all frequent k-mers."""

import random
from collections import Counter
from math import ceil

from helixframe import queries
from helixframe.operators import detect


def _brute(seqs, k, over, longest):
    seqs, found, layer = set(seqs), {}, None
    length = max(map(len, seqs))
    while k <= longest:
        least = ceil(len(seqs) * max(over, (length - k + 1) * 100 / 4**k))
        c = Counter(x for s in seqs for x in {s[i : i + k] for i in range(len(s) - k + 1)} if layer is None or x[:-1] in layer)
        layer = {x: m for x, m in c.items() if m > least}
        if not layer:
            break
        found |= layer
        k += 1
    return found


def test_more_kmers_than_ten_thousand(spark):
    rnd = random.Random(1)
    seqs = [a + "".join(rnd.choices("ACGT", k=99)) for a in "C" for _ in range(150)]
    seqs += ["G" + s[1:] for s in seqs]
    reads = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "read_idx long, sequence string")
    got = dict(detect.frequent_kmers(reads, 12, 0.001, longest=13))
    assert got == _brute(seqs, 12, 0.001, 13)
    assert sum(len(x) == 12 for x in got) > 10_000


def test_ids_beyond_the_first(spark):
    core, rnd = "GATTACACATGCCATGGA", random.Random(2)
    seqs = ["".join(rnd.choices("CGT", k=10)) + core + "".join(rnd.choices("CGT", k=10)) for _ in range(40)]
    reads = spark.createDataFrame([(10**9 + 7 * i, s) for i, s in enumerate(seqs)], "read_idx long, sequence string")
    assert detect.detect(reads) == []
    found = detect.detect(reads, [("core", core)], max_reads=None)
    assert found[0].known == ("core",) and core in found[0].sequence
    best = detect.merge_substrings(sorted(_brute(seqs, 12, 0.001, 38).items()))
    assert [(c.sequence, c.count) for c in found] == [(c.sequence, c.count) for c in best][: detect.TOP]


def test_query_reads_late_documents(spark, tmp_path):
    rnd = random.Random(3)
    texts = ["".join(rnd.choices("bcd", k=10)) + "dabcdabcdabcaacd" + "".join(rnd.choices("bcd", k=10)) for _ in range(40)]
    spark.createDataFrame([(50_000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.Q["detect_heuristic"](spark, str(tmp_path)).collect()
    assert any("k1" in r.known for r in rows)
