"""The vectorised aligner against a plain matrix, cell by cell."""

import random

import numpy as np
import pytest

from helixframe.operators import kernels
from helixframe.operators.adapters import Adapter, expand_braces, match_batch, parse, parse_all


def plain(ref, query, flags, rate, overlap, indel=1):
    m, n = len(ref), len(query)
    free_a, free_r = flags & 1, flags & 2
    col = [((0 if free_a else i * indel), 0, (-i if free_a else 0)) for i in range(m + 1)]
    best = None

    def consider(i, j, cell):
        nonlocal best
        cost, same, origin = cell
        size = i + min(origin, 0)
        if size >= overlap and cost <= size * rate and (best is None or same > best[4] or same == best[4] and cost < best[5]):
            best = (max(-origin, 0), i, max(origin, 0), j, same, cost)

    if n == 0:
        for i in range(m + 1) if flags & 4 else (m,):
            consider(i, 0, col[i])
    for j in range(1, n + 1):
        new = [(0, 0, j) if free_r else (j * indel, 0, 0)]
        for i in range(1, m + 1):
            if ref[i - 1] == query[j - 1]:
                c, s, o = col[i - 1]
                new.append((c, s + 1, o))
                continue
            d, up, left = col[i - 1], new[i - 1], col[i]
            a, b, e = d[0] + 1, up[0] + indel, left[0] + indel
            new.append((a, d[1], d[2]) if a <= b and a <= e else (b, up[1], up[2]) if b <= e else (e, left[1], left[2]))
        col = new
        if flags & 8:
            consider(m, j, col[m])
        if j == n:
            for i in range(m + 1) if flags & 4 else (m,):
                consider(i, j, col[i])
    return best


@pytest.mark.parametrize("flags", [14, 11, 8, 2, 15, 9])
@pytest.mark.parametrize("indel", [1, 3])
def test_locate_equals_plain(flags, indel):
    rng = random.Random(flags * 10 + indel)
    for _ in range(6):
        ref = "".join(rng.choice("ACG") for _ in range(rng.randint(1, 9)))
        reads = ["".join(rng.choice("ACG") for _ in range(rng.randint(0, 14))) for _ in range(40)]
        reads += [ref, ref[1:], "A" + ref + "C", ""]
        got = kernels.locate(ref, *kernels.encode(reads), flags, 0.34, 2, indel)
        for r, g in zip(reads, got):
            want = plain(ref, r, flags, 0.34, 2, indel)
            assert (None if g[0] < 0 else tuple(g)) == want, (ref, r)


def test_locate_with_an_adapter_each():
    rng = random.Random(5)
    refs = ["".join(rng.choice("ACGT") for _ in range(rng.randint(3, 12))) for _ in range(60)]
    reads = ["".join(rng.choice("ACGT") for _ in range(rng.randint(3, 15))) for _ in range(60)]
    a, n = kernels.encode(refs)
    got = kernels.locate(a, *kernels.encode(reads), 15, 0.3, 2, adapter_lengths=n)
    for ref, r, g in zip(refs, reads, got):
        assert (None if g[0] < 0 else tuple(g)) == plain(ref, r, 15, 0.3, 2)


def test_wildcards():
    read = ["ACNT"]
    assert match_batch(Adapter("a", "ACGT", "prefix", indels=False, max_error_rate=0.0, min_overlap=3), read) == [None]
    assert match_batch(Adapter("a", "ACGT", "prefix", indels=False, max_error_rate=0.0, min_overlap=3, read_wildcards=True), read)[0][4] == 4
    assert match_batch(Adapter("a", "ACNT", "prefix", max_error_rate=0.0), ["ACGT"])[0][4] == 4
    assert match_batch(Adapter("a", "AXGT", "prefix", max_error_rate=0.0), ["ACGT"]) == [None]


def test_exact_hits_are_leftmost():
    assert match_batch(Adapter("a", "AC"), ["TTACAC"])[0][:4] == (0, 2, 2, 4)
    assert match_batch(Adapter("a", "AC", "suffix"), ["TTACAC"])[0][2] == 4


def test_specifications():
    assert expand_braces("AC{3}G") == "ACCCG"
    for bad in ("A{", "A}", "{3}", "A{x}"):
        with pytest.raises(ValueError):
            expand_braces(bad)
    assert parse("n=^ACGT", "front").where == "prefix"
    assert parse("ACGT$").where == "suffix"
    a = parse("AC...GT")
    assert (a.where, a.sequence, a.back.sequence) == ("linked", "AC", "GT")
    assert parse("...GT").where == "back" and parse("AC...").where == "prefix"
    assert [x.name for x in parse_all([("back", "ACC"), ("back", "b=GGT")])] == ["1", "b"]
    for bad in (("^ACGT", "back"), ("ACJT", "back"), ("", "back")):
        with pytest.raises(ValueError):
            parse(*bad)


def test_insert_alignment():
    rng = random.Random(1)
    insert = "".join(rng.choice("ACGT") for _ in range(20))
    rc = insert[::-1].translate(str.maketrans("ACGT", "TGCA"))
    a1, a2 = "TTAGACATAT", "CAGTGGAGTA"
    r1, n1 = kernels.encode([insert + a1])
    r2, n2 = kernels.encode([rc + a2])
    size, wrong, cut, l1, l2, errors = kernels.insert_matches(r1, n1, r2, n2, a1, a2)[0]
    assert (size, wrong, cut, l1, l2, errors) == (20, 0, 1, 10, 10, 0)
    r1, n1 = kernels.encode([(insert + a1)[:22]])
    r2, n2 = kernels.encode([(rc + a2)[:22]])
    assert kernels.insert_matches(r1, n1, r2, n2, a1, a2)[0][0] == 20


def test_correction():
    s1, q1, s2, q2, c1, c2 = kernels.correct("ACGTA", "IIIII", "TACAT", "I####", 0, 5, 0, "conservative")
    assert (s1, s2, q2[3], c1, c2) == ("ACGTA", "TACGT", "I", 0, 1) or (c1, c2) == (0, 1)
    s1, _, s2, _, c1, c2 = kernels.correct("ANGT", "IIII", "ACAT", "IIII", 0, 4, 0, "N")
    assert "N" in s1 and c1 == c2
    s1, *_ = kernels.correct("ANGT", "IIII", "ACGT", "####", 0, 4, 0, "conservative")
    assert s1 == "ACGT"
    assert kernels.correct("ACGT", None, "ACGT", None, 0, 4, 0, "liberal")[4:] == (0, 0)
    with pytest.raises(ValueError):
        kernels.correct("ACGA", None, "ACGT", None, 0, 4, 0, "liberal")


def test_reverse_complement():
    reads, n = kernels.encode(["ACGTN", "AAC", ""])
    out = kernels.reverse_complement(reads, n)
    assert [out[i, : n[i]].tobytes() for i in range(3)] == [b"NACGT", b"GTT", b""]
    assert isinstance(out, np.ndarray)
