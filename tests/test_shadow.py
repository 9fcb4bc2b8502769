"""Shadow regression against brute force on more reads than a thousand."""

import random
from collections import Counter

import pytest

from helixframe.operators import error


def test_all_reads_count(spark):
    rnd = random.Random(5)
    seqs = ["".join(rnd.choices("ACGT", k=rnd.choice((6, 7)))) for _ in range(6000)] + ["AAAAAA", "ACNT", ""]
    n = Counter(s for s in seqs if s and "N" not in s and len(set(s)) > 1)
    assert len(n) > 2000
    shadows = {s: sum(n.get(s[:i] + c + s[i + 1 :], 0) for i in range(len(s)) for c in "ACGT" if c != s[i]) for s in n}
    slope = sum(n[s] * shadows[s] for s in n) / sum(c * c for c in n.values())
    r = error.shadow_error_rate(spark.createDataFrame([(s,) for s in seqs], "sequence string")).first()
    bases = sum(map(len, n))
    assert r.bases == bases and r.slope == pytest.approx(slope)
    assert r.error_rate == pytest.approx(1 - (1 / (1 + slope)) ** (len(n) / bases))
