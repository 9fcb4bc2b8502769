"""Split scans: whatever the parts, the records are those of the whole file, each once and in order."""

import gzip
import io
import random
import struct

import pytest

from helixframe.sources import records


def text_of(rows, end="\n", last=True):
    text = "".join(f"@{n}{end}{s}{end}+{p}{end}{q}{end}" for n, s, p, q in rows)
    return (text if last else text[: -len(end)]).encode()


def parts(data, step, **how):
    """Records of all parts of a size, and the sum of what the count pass says."""
    got, n = [], 0
    for at in range(0, max(len(data), 1), step):
        stop = min(at + step, len(data))
        here = [r for c in records.fastq_blocks(io.BytesIO(data), "x", at, stop, **how) for r in zip(*c)]
        assert records.fastq_count(io.BytesIO(data), at, stop) == len(here), (step, at)
        got += here
        n += len(here)
    return got


def fixed(rng, n):
    return [(f"r{i:04d}", "".join(rng.choice("ACGT") for _ in range(11)), "", "".join(rng.choice("@+I#") for _ in range(11))) for i in range(n)]


def varying(rng, n):
    rows = []
    for i in range(n):
        k = rng.choice([0, 1, 2, 5, 30])
        q = rng.choice(["@", "+", "I"]) + "".join(rng.choice("@+I#") for _ in range(k))
        rows.append((f"r{i}" + " c" * rng.randint(0, 3), "".join(rng.choice("ACGTN") for _ in range(k)), "", q[:k]))
    return rows


@pytest.mark.parametrize("make", [fixed, varying])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("last", [True, False])
def test_every_split_size(make, end, last):
    rng = random.Random(len(end) * 2 + last)
    rows = make(rng, 12)
    if not last and not rows[-1][1]:
        rows[-1] = ("end", "A", "", "@")
    data = text_of(rows, end, last)
    want = [(n, p, s, q, None) for n, s, p, q in rows]
    for step in range(1, 4 * max(len(text_of([r], end)) for r in rows) + 1):
        assert parts(data, step) == want, step


def test_small_blocks(monkeypatch):
    monkeypatch.setattr(records, "_BLOCK", 7)
    rows = varying(random.Random(3), 30)
    data = text_of(rows)
    for step in (1, 9, 50, 51, 64, 1000, len(data)):
        assert [r[:1] + r[2:4] for r in parts(data, step)] == [(n, s, q) for n, s, _, q in rows]


def test_colour_space_splits():
    rows = [(f"r{i}", "T" + "0123"[: i % 5] + "1", "", "@+I#I"[: len("0123"[: i % 5]) + 1]) for i in range(9)]
    data = text_of(rows)
    for step in range(1, 60):
        assert [(r[0], r[4], r[2], r[3]) for r in parts(data, step, colorspace=True)] == [(n, "T", s[1:], q) for n, s, _, q in rows]


@pytest.mark.parametrize("cut", range(1, 17))
def test_a_file_that_ends_within_a_record_is_an_error_whatever_the_split(cut):
    data = text_of([("r1", "ACGT", "", "@@@@"), ("r2", "AC", "", "@+"), ("r3", "ACGTA", "", "@IIII")])[:-cut]
    if cut == 1:
        assert len(parts(data, 5)) == 3
        return
    for step in range(1, len(data) + 1):
        with pytest.raises(records.FormatError):
            parts(data, step)


def test_faults():
    for bad in (b"r\nA\n+\nI\n", b"@r\nA\n-\nI\n", b"@r\nAC\n+\nI\n", b"@r\nA\n+q\nI\n"):
        with pytest.raises(records.FormatError):
            parts(bad, 1000)
    assert parts(b"@r x\nA\n+r x\nI\n", 1000) == [("r x", "r x", "A", "I", None)]
    assert parts(b"", 10) == []


@pytest.mark.parametrize("split", [50, 127, 128, 508, 1 << 20])
def test_frames(spark, tmp_path, split):
    rng = random.Random(split)
    one, two = fixed(rng, 70), varying(rng, 70)
    two = [(a[0], *b[1:]) for a, b in zip(one, two)]
    (tmp_path / "1.fq").write_bytes(text_of(one))
    (tmp_path / "2.fq").write_bytes(text_of(two))
    got = records.read_fastq(spark, str(tmp_path / "1.fq"), split=split).orderBy("read_idx").collect()
    assert [(r.read_idx, r.name, r.sequence, r.qualities) for r in got] == [(i, n, s, q) for i, (n, s, _, q) in enumerate(one, 1)]
    both = records.pair_up(*[records.read_fastq(spark, str(tmp_path / f"{k}.fq"), split=split) for k in (1, 2)]).orderBy("read_idx").collect()
    assert [(r.r1.sequence, r.r2.sequence) for r in both] == [(a[1], b[1]) for a, b in zip(one, two)]
    (tmp_path / "i.fq").write_bytes(text_of([x for p in zip(one, two) for x in p]))
    mixed = records.interleaved(records.read_fastq(spark, str(tmp_path / "i.fq"), split=split)).orderBy("read_idx").collect()
    assert [(r.read_idx, r.r1.sequence, r.r2.sequence) for r in mixed] == [(i, a[1], b[1]) for i, (a, b) in enumerate(zip(one, two), 1)]


def test_folder_and_gzip(spark, tmp_path):
    rows = fixed(random.Random(5), 60)
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a-0.fq").write_bytes(text_of(rows[:20]))
    (tmp_path / "d" / "a-1.fq.gz").write_bytes(gzip.compress(text_of(rows[20:50])))
    (tmp_path / "d" / "a-2.fq").write_bytes(text_of(rows[50:]))
    (tmp_path / "d" / "_SUCCESS").write_bytes(b"")
    got = records.read_fastq(spark, str(tmp_path / "d"), split=90).orderBy("read_idx").collect()
    assert [(r.read_idx, r.name) for r in got] == [(i, r[0]) for i, r in enumerate(rows, 1)]
    (tmp_path / "empty").mkdir()
    assert records.read_fastq(spark, str(tmp_path / "empty")).count() == 0


def bam(rows):
    out = b"BAM\1" + struct.pack("<i", 4) + b"@HD\n" + struct.pack("<i", 1) + struct.pack("<i", 2) + b"c\0" + struct.pack("<i", 9)
    for name, flag, seq, qual in rows:
        codes = ["=ACMGRSVTWYHKDBN".index(c) for c in seq] + [0] * (len(seq) % 2)
        body = struct.pack("<iiBBHHHiiii", -1, -1, len(name) + 1, 0, 0, 1, flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + b"\1\0\0\0"
        body += bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(codes), 2)) + (b"\xff" * len(seq) if qual is None else bytes(ord(c) - 33 for c in qual))
        out += struct.pack("<i", len(body)) + body
    return out


@pytest.mark.parametrize("kind", ["sam", "bam"])
def test_alignments(spark, tmp_path, kind):
    rows = [("p", 64 | 1, "ACGTA", "IIII#"), ("p", 128 | 1, "GGT", None), ("q", 128 | 1, "T", "I"), ("q", 64 | 1, "NACN", "!!II")]
    path = str(tmp_path / f"x.{kind}")
    if kind == "sam":
        text = "@HD\tVN:1\n" + "".join("\t".join([n, str(f), "*", "0", "0", "*", "*", "0", "0", s, q or "*"]) + "\n" for n, f, s, q in rows)
        (tmp_path / "x.sam").write_text(text)
    else:
        (tmp_path / "x.bam").write_bytes(gzip.compress(bam(rows)))
    got = records.open_reads(spark, path).orderBy("read_idx").collect()
    assert [(r.read_idx, r.name, r.sequence, r.qualities) for r in got] == [(i, n, s, q) for i, (n, _, s, q) in enumerate(rows, 1)]
    assert [r.sequence for r in records.open_reads(spark, path, mates="1").orderBy("read_idx").collect()] == ["ACGTA", "NACN"]
    pairs = records.open_reads(spark, path, mates="paired").orderBy("read_idx").collect()
    assert [(r.read_idx, r.r1.sequence, r.r2.sequence) for r in pairs] == [(1, "ACGTA", "GGT"), (2, "NACN", "T")]
    if kind == "sam":
        for step in range(1, 70, 3):
            assert [r.name for r in records.read_sam(spark, path, split=step).orderBy("read_idx").collect()] == ["p", "p", "q", "q"]
            if step > 10:
                break
        (tmp_path / "bad.sam").write_text("p\t64\n")
        with pytest.raises(Exception, match="no alignment line"):
            records.read_sam(spark, str(tmp_path / "bad.sam")).collect()
