"""Merging against a plain matrix; places, known adapters, detection thresholds, option values, synced and empty files."""

import random

import pytest
from pyspark.sql import functions as F

from helixframe.operators import adapters as ad
from helixframe.operators import detect, filters, kernels, pairs
from helixframe.plans import values
from helixframe.plans.trim import TrimOptions, TrimPlan, pair_summary, report, summary
from helixframe.sources import sinks

from .test_kernels import plain

BACK = str.maketrans("ACGT", "TGCA")


def pair_frame(spark, rows):
    df = spark.createDataFrame([(i, f"p{i}", a, "I" * len(a), b, "5" * len(b)) for i, (a, b) in enumerate(rows)], "read_idx long, name string, s1 string, q1 string, s2 string, q2 string")
    return df.select("read_idx", pairs.read_struct(F.col("name"), F.col("s1"), F.col("q1")).alias("r1"), pairs.read_struct(F.col("name"), F.col("s2"), F.col("q2")).alias("r2"))


def merged(a, b, share, rate):
    """The merged read by the plain matrix, or None."""
    rc = b.translate(BACK)[::-1]
    need = max(2, round(share * min(len(a), len(b))))
    if min(len(a), len(b)) < need:
        return None
    g = plain(rc, a, 15, rate, 1)
    if g is None or g[4] < need:
        return None
    r2_start, r2_stop, r1_start, r1_stop = g[:4]
    if r2_start == 0 and r2_stop == len(rc):
        return a
    if r1_start == 0 and r1_stop == len(a):
        return rc
    return a + rc[r2_stop:] if r1_start > 0 else rc + a[r1_stop:]


def test_merge_equals_plain(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(150):
        whole = "".join(rng.choice("ACGT") for _ in range(rng.randint(3, 30)))
        cut = rng.randint(0, len(whole) // 2)
        a, b = whole[: len(whole) - cut] if rng.random() < 0.5 else whole, whole[rng.randint(0, cut) :].translate(BACK)[::-1]
        if rng.random() < 0.5 and len(a) > 4:
            at = rng.randrange(len(a))
            a = a[:at] + rng.choice(["", "A", "CT"]) + a[at + 1 :]
        rows.append((a, b))
    rows += [("", "ACG"), ("A", "T"), ("ACGTACGT", "ACGTACGT"), ("AACC", "GGTT")]
    for share in (0.9, 0.4):
        out = pairs.merge_overlapping(pair_frame(spark, rows), share, 0.2).collect()
        some = 0
        for r in out:
            a, b = rows[r.read_idx]
            want = merged(a, b, share, 0.2) if a and b else None
            assert (r.r1.merged, r.r1.sequence, r.r2 is None) == (want is not None, a if want is None else want, want is not None), (a, b)
            assert len(r.r1.qualities) == len(r.r1.sequence)
            some += want is not None
        assert some > 30


def test_all_places():
    got = kernels.locate_all("AGAGATCAGATGACAGATC", "GATCA", 0.0, 3)
    assert got == [(3, 8, 0, 5, 5, 0), (15, 19, 0, 4, 4, 0)]
    assert kernels.locate_all("GATATCAGATGACAGATCAGAGATCAGAT", "GAGATCAGATGA", 0.1, 10) == [(0, 12, 0, 12, 11, 1), (19, 29, 0, 10, 10, 0)]
    assert kernels.locate_all("", "A", 0, 1) == kernels.locate_all("A", "", 0, 1) == []
    rng = random.Random(2)
    for _ in range(50):
        a, b = ("".join(rng.choice("AC") for _ in range(rng.randint(1, 9))) for _ in range(2))
        want = []
        for at in range(len(a)):
            n = min(len(b), len(a) - at)
            wrong = sum(x != y for x, y in zip(a[at:], b))
            if n >= 2 and wrong <= n * 0.4:
                want.append((at, at + n, 0, n, n - wrong, wrong))
        assert kernels.locate_all(a, b, 0.4, 2) == want
        flags = rng.choice([14, 11, 8, 2, 15])
        reads, lengths = kernels.encode([b])
        g = kernels.locate(a, reads, lengths, flags, 0.4, 1)[0]
        if g[0] == 0 and flags in (8, 2):
            assert kernels.matrix(a, b, flags)[g[1]][g[3]] <= g[5]
    assert kernels.overlaps_exactly("AACCGGTT", "CCGGTTAC", 0.7) and not kernels.overlaps_exactly("AACCGGTT", "CCGGTTAC", 0.9)
    assert kernels.overlaps_exactly("AACCGG", "CC") and not kernels.overlaps_exactly("AAAA", "CCCC")


def test_adapter_files_and_grammar(tmp_path):
    path = tmp_path / "a.fa"
    path.write_text(">one first\nACGT\n>two\nGATT\nACA\n")
    got = ad.parse_all([("back", f"file:{path}"), ("front", "^TTT"), ("back", "x=GGG")])
    assert [(a.name, a.sequence, a.where) for a in got] == [("one", "ACGT", "back"), ("two", "GATTACA", "back"), ("3", "TTT", "prefix"), ("x", "GGG", "back")]
    with pytest.raises(ValueError):
        ad.parse("...ACGT", "front")
    assert ad.parse("...ACGT", "back").where == "back"
    with pytest.raises(ValueError):
        ad.expand_braces("A{10001}")
    known = ad.KnownAdapters([("a", "AACG"), ("b", "AACG"), ("c", "TT")], reverse=True)
    assert known.names["AACG"] == ["a", "b"] and known.sequence("a_rc") == "CGTT" and known.sequence("zz") is None
    known.save(str(tmp_path / "k.fa"))
    assert ad.KnownAdapters.load(str(tmp_path / "k.fa")).names == known.names


def test_detection_thresholds_and_reports(spark):
    core = "GATTACACATGCCATGGACT"
    rng = random.Random(3)
    seqs = ["".join(rng.choices("CGT", k=12)) + core for _ in range(60)]
    reads = spark.createDataFrame(list(enumerate(seqs, 1)), "read_idx long, sequence string")
    assert detect.least_known(10_000, 100, [("c", core)]) == 1 and detect.least_known(10_000, 100, [("c", "ACGTAC"), ("d", core)]) > 20_000
    assert [c.known for c in detect.detect(reads, [("core", core)], include="known", min_kmer_match=0.2)] == [("core",)]
    assert detect.detect(reads, [("core", core), ("short", "GATTAC")], include="known", min_kmer_match=0.2, k=6) == []
    counted = {r.kmer: r.n for r in detect.frequent_known(reads, [("core", core)], 60, 32, 8, over=1).collect()}
    assert counted == {core[i : i + 8]: 60 for i in range(13)}
    pairs_ = reads.select("read_idx", F.struct("sequence").alias("r1"), F.when(F.col("read_idx") > 0, F.struct(F.reverse("sequence").alias("sequence"))).alias("r2"))
    one, two = detect.detect_pairs(pairs_, [("core", core)], max_reads=None)
    assert one[0].known == ("core",) and core[::-1] in two[0].sequence
    shown = detect.reported([*one, detect.Contaminant("A" * 30, 99), detect.Contaminant("ACGT", 99)], include="known")
    assert shown == [c for c in one if c.known][:20]
    assert detect.fasta_lines(shown[:1]).startswith(f">1 count={shown[0].count} known=core\n{shown[0].sequence}\n")


def test_values():
    assert values.whole_number("3k") == 3000 and values.whole_number("2M") == 2_000_000 and values.number_or_text("x3") == "x3" and values.positive(5) == 5
    for bad, f in (("1.5", values.whole_number), ("-1", values.positive), ("1.5", values.chance), ("AX", lambda t: values.letters(t, "ABC"))):
        with pytest.raises(ValueError):
            f(bad)
    assert values.delimited("1, 2", int, 2, 2) == [1, 2] and values.delimited("") == [] and values.letters("gaq", "ACGQW") == "GAQ" and values.chance("0.5") == 0.5
    assert values.statistics_wanted("tiles:pattern=x:all; bases") == {"tiles": {"pattern": "x", "all": "true"}, "bases": {}}
    assert values.sample_name("/a/s1_R1.fastq.gz", "/b/s1_R2.fastq.gz") == "s1" and values.sample_name("x.fq") == "x" and values.sample_name("s.1.fq", "s.2.fq") == "s"
    assert values.shortened("abcdef", 5) == "ab..." and values.shortened(None) is None and list(values.numbered_in("abc", 1, 3)) == [(1, "a"), (2, "b")]
    assert values.rows({"a": {"b": 1}, "c": [2, 3]}) == [("a", "b", 1), ("c", 0, 2), ("c", 1, 3)]
    assert values.as_yaml({"a": {"b": 1}, "c": [2, {"d": None}], "e": []}) == '"a":\n  "b": 1\n"c":\n  - 2\n  -\n    "d": null\n"e": []\n'
    assert values.readable("-") == "-" and values.writable("/tmp/x") == "/tmp/x"
    with pytest.raises(ValueError):
        values.readable("/no/such")


def test_files_and_reports(spark, tmp_path):
    p = pair_frame(spark, [("ACGT" * (i % 4 + 1), "TTGG" * (i % 3 + 1)) for i in range(40)]).repartition(5)
    sinks.write_pairs(p, str(tmp_path / "1"), str(tmp_path / "2"))
    one, two = ([x for f in sorted((tmp_path / k).glob("part-*")) for x in f.read_text().split("\n")[::4] if x] for k in "12")
    assert one == two == [f"@p{i}" for i in range(40)]
    reads = spark.createDataFrame([(1, "a", "ACGTGATTA", "IIIIIIIII"), (2, "b", "AC", "II")], "read_idx long, name string, sequence string, qualities string")
    out = TrimPlan.of(TrimOptions(adapters=[("back", "GATTA")], cut=[1])).run(reads)
    s = summary(out).collect()
    assert [(r.records, r.bp_clipped, r.bp_adapters, r.mean_length) for r in s] == [(2, 2, 5, 2.0)]
    assert '"records": 2' in report(out) and '"records": 2' in report(out, kind="yaml") and "2 reads" in report(out, as_json=False)
    sinks.write_all(filters.route(reads, [("short", F.length("sequence") < 5)]), str(tmp_path / "all"), ["main", "short", "too_long"])
    assert {x.name for x in (tmp_path / "all").iterdir() if x.is_dir()} == {"dest=main", "dest=short", "dest=too_long"}
    fixed = TrimPlan.of(TrimOptions(adapters=[("back", "AGATCGGAAGAGC")], adapters2=[("back", "AGATCGGAAGAGC")], aligner="insert", correct="liberal")).run_pairs(pair_frame(spark, [("ACGGTACCATTGACAAGATCGG", "TTGTCAATGGTACCCTAGATCG")]))
    got = pair_summary(fixed).first()
    assert (got.n_pairs, got.n_corrected, got.read1_corrected + got.read2_corrected) == (1, 1, 1)
