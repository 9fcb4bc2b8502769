"""Frequent k-mers of all sizes in two passes: against brute force, in parts, and how many jobs they take."""

import random
from collections import Counter
from math import ceil

import pyarrow as pa
import pytest

from helixframe.operators import detect, growth


def _brute(seqs, k, over, longest):
    seqs, found, layer = set(seqs), {}, None
    length = max(map(len, seqs))
    while k <= min(longest, length):
        c = Counter(x for s in seqs for x in {s[i : i + k] for i in range(len(s) - k + 1)} if layer is None or x[:-1] in layer)
        layer = {x: m for x, m in c.items() if m > ceil(len(seqs) * max(over, (length - k + 1) * 100 / 4**k))}
        if not layer:
            break
        found |= layer
        k += 1
    return found


def _texts(seed, n, alphabet="ACGTN"):
    rnd = random.Random(seed)
    words = ["".join(rnd.choices(alphabet, k=rnd.randint(1, 9))) for _ in range(12)]
    return ["".join(rnd.choices(words, k=rnd.randint(0, 9))) for _ in range(n)]


def test_all_sizes_take_few_jobs(spark):
    rnd = random.Random(1)
    core = "".join(rnd.choices("ACGT", k=60))
    seqs = ["".join(rnd.choices("ACGT", k=10)) + core + "".join(rnd.choices("ACGT", k=10)) for _ in range(50)]
    reads = spark.createDataFrame([(s,) for s in seqs], "sequence string")
    spark.sparkContext.setJobGroup("growth", "growth")
    try:
        found = dict(detect.frequent_kmers(reads, 12, 0.1))
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("growth"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found == _brute(seqs, 12, 0.1, 80) and {len(x) for x in found} >= set(range(12, 61))
    assert jobs < 20


@pytest.mark.parametrize("longest", [None, 14])
def test_parts_find_what_the_whole_has(spark, monkeypatch, longest):
    seqs = _texts(2, 900)
    reads = spark.createDataFrame([(s,) for s in [*seqs, *seqs[:50]]], "sequence string").repartition(7)
    want = _brute(seqs, 12, 0.05, longest or 10**6)
    assert want
    monkeypatch.setattr(growth, "PART_LETTERS", 8000)
    assert dict(detect.frequent_kmers(reads, 12, 0.05, longest)) == want
    monkeypatch.setattr(detect, "LEAST_IN_PART", 10**9)
    assert dict(detect.frequent_kmers(reads, 12, 0.05, longest)) == want


def test_nothing_frequent(spark):
    reads = spark.createDataFrame([("ACGTTGCAACGTAG",), ("",), (None,)], "sequence string")
    assert detect.frequent_kmers(reads) == [] and detect.frequent_kmers(reads.limit(0)) == [] and detect.frequent_kmers(reads, 20) == []


@pytest.mark.parametrize("alphabet", ["AC", "ACGTN", "Aé日C", "".join(map(chr, range(40, 90)))])
@pytest.mark.parametrize("k", [1, 5, 13])
def test_one_part(alphabet, k):
    seqs = [*_texts(k, 60, alphabet), "", None]
    p = growth.part([pa.array(seqs[:9], pa.string()), pa.array(seqs[9:], pa.string())])
    count = Counter(x for s in seqs if s for x in {s[i : i + n] for n in range(k, len(s) + 1) for i in range(len(s) - n + 1)})
    want = {x: n for x, n in count.items() if n > 3}
    ends = growth.longest_frequent(p, k, 10**6, 3, len(seqs))
    assert sorted(ends) == sorted(x for x in want if not any(y[:-1] == x for y in want))
    trie = growth.Trie(ends, k)
    got = trie.counts(p)
    assert {trie.word(i): got[i] for i in range(len(got)) if trie.depth[i] >= k} == want


def test_parts_hold_all_texts(monkeypatch):
    monkeypatch.setattr(growth, "PART_LETTERS", 100)
    seqs = _texts(4, 500)
    batches = [pa.RecordBatch.from_pydict({"s": pa.array(seqs[i : i + 7], pa.string())}) for i in range(0, 500, 7)]
    made = list(growth.parts(iter(batches)))
    assert len(made) > 10 and all(len(p.chars) >= 100 for p in made[:-1])
    assert "".join("".join(map(chr, p.chars)) for p in made) == "".join(seqs) and sum(p.texts for p in made) == 500
