"""Small cases made from the specification, over DataFrames."""

import bz2
import gzip
import lzma

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from helixframe.functions import dna
from helixframe.functions.probability import error_ranges, random_match
from helixframe.operators import adapters as ad
from helixframe.operators import detect, error, filters, pairs, qc
from helixframe.operators import modifiers as mo
from helixframe.plans.trim import TrimOptions, TrimPlan, report, summary
from helixframe.sources import records, sinks
from helixframe.streaming import trim as stream


def frame(spark, rows):
    return spark.createDataFrame([(i, f"r{i}", s, q) for i, (s, q) in enumerate(rows, 1)], "read_idx long, name string, sequence string, qualities string")


def seqs(df):
    return [r.sequence for r in df.orderBy("read_idx").collect()]


def test_quality_trim(spark):
    r = mo.prepared(frame(spark, [("ACGTTTACGTA", "##456789###"), ("", ""), ("AC", "##")]))
    got = mo.quality_trimmer(10, 10)(r).orderBy("read_idx").collect()
    assert [(x.sequence, x.qualities) for x in got] == [("GTTTAC", "456789"), ("", ""), ("", "")]
    assert seqs(mo.quality_trimmer(0, 10)(r))[0] == "ACGTTTAC"
    assert seqs(mo.quality_trimmer(10, 0)(r))[0] == "GTTTACGTA"
    assert got[0].clipped == [2, 3, 0, 0]


def test_nextseq_counts_g_as_bad(spark):
    r = mo.prepared(frame(spark, [("TCTCGTATGGGG", "IIIIIIIIIIII")]))
    assert seqs(mo.nextseq_trimmer(22)(r)) == ["TCTCGTAT"]


def test_cutters(spark):
    r = mo.prepared(frame(spark, [("ACGTACG", "IIIIIII"), ("", ""), ("A", None)]))
    assert seqs(mo.cutter([3])(r)) == ["TACG", "", ""]
    assert seqs(mo.cutter([-3])(r)) == ["ACGT", "", ""]
    assert seqs(mo.cutter([100, -100])(r)) == ["", "", ""]
    n = mo.prepared(frame(spark, [("NNNNAAACNNNCTTGGNNN", "I" * 19), ("NNN", "III")]))
    assert seqs(mo.n_end_trimmer()(n)) == ["AAACNNNCTTGG", ""]
    twice = mo.min_cutter([4, -4])(mo.cutter([2, -2])(mo.prepared(frame(spark, [("ACGTACGTAC", "I" * 10)]))))
    assert seqs(twice) == ["TA"[:0] + "ACGTACGTAC"[4:6]]


def test_bisulfite(spark):
    r = mo.prepared(frame(spark, [("CAATTT", "IIIIII"), ("CGATTT", "IIIIII"), ("TTTTTT", "IIIIII")]))
    assert seqs(mo.non_directional_bisulfite_trimmer()(r)) == ["ATTT", "ATTT", "TTTTTT"]
    assert seqs(mo.swift_bisulfite_trimmer(1, 2)(r))[2] == "TTTT"
    cut = ad.cut_exact(frame(spark, [("ACGTTTGATTA", "I" * 11), ("ACGTTT", "IIIIII")]), ad.Adapter("x", "GATTA"))
    assert seqs(mo.rrbs_trimmer()(cut)) == ["ACGT", "ACGTTT"]


def test_functions(spark):
    one = frame(spark, [("ACGTN", "I#I#I")])
    row = one.select(
        dna.reverse_complement(F.col("sequence")).alias("rc"), dna.gc_percent(F.col("sequence")).alias("gc"), dna.mean_quality(F.col("qualities")).alias("q"), dna.colour_encode(F.col("sequence")).alias("c"),
        dna.names_match(F.lit("a/1 x"), F.lit("a/2")).alias("m1"), dna.names_match(F.lit("a1"), F.lit("b2")).alias("m2"), dna.double_encode(F.lit("0123.")).alias("d"), dna.complexity(F.lit("ACGT")).alias("e"),
    ).first()
    assert (row.rc, row.gc, row.q, row.c, row.m1, row.m2, row.d, row.e) == ("NACGT", 40, 25, "A131.", True, False, "ACGTN", 2.0)
    assert abs(random_match(3, 5) - sum(p for p in (10 * 0.25**3 * 0.75**2, 5 * 0.25**4 * 0.75, 0.25**5))) < 1e-12
    assert error_ranges(20, 0.1) == [(0, 1, 9), (1, 10, 19), (2, 20, 20)]


def test_adapters(spark):
    r = frame(spark, [("TTTTGATTACA", "I" * 11), ("GATTACA", "I" * 7), ("", ""), ("CCCC", "IIII"), ("TTTTGATAACAGG", "I" * 13)])
    out = ad.cut_adapters(r, [ad.parse("a=GATTACA", max_error_rate=0.15)])
    assert seqs(out) == ["TTTT", "", "", "CCCC", "TTTT"]
    assert [x.adapter_name for x in out.orderBy("read_idx").collect()] == ["a", "a", None, None, "a"]
    assert seqs(ad.cut_adapters(r, [ad.parse("a=GATTACA")], action="mask"))[0] == "TTTTNNNNNNN"
    kept = ad.cut_adapters(r, [ad.parse("a=GATTACA")], action=None)
    assert seqs(kept)[0] == "TTTTGATTACA" and kept.where("adapter_name is not null").count() == 2
    exact, full = ad.cut_exact(r, ad.Adapter("a", "GATTACA")), ad.cut_adapters(r, [ad.Adapter("a", "GATTACA", max_error_rate=0.0)])
    assert seqs(exact) == seqs(ad.cut_adapters(r, [ad.Adapter("a", "GATTACA", max_error_rate=0.0, min_overlap=7)]))
    assert ad.length_error_histogram(full).count() > 0 and ad.adjacent_bases(full).count() > 0
    two = ad.cut_adapters(frame(spark, [("AAAAGATTACATTTGATTACA", "I" * 21)]), [ad.parse("b=TTTGATTACA"), ad.parse("a=GATTACA")], times=2)
    assert seqs(two) == ["AAAA"]
    linked = ad.cut_adapters(frame(spark, [("ACCGGGGTTAGG", "I" * 12), ("GGGGTTAGG", "I" * 9)]), [ad.parse("x=ACC...TTAGG")])
    assert seqs(linked) == ["GGGG", "GGGGTTAGG"]
    assert [x.fields[:2] for x in ad.info(out).orderBy("read_idx").collect()][3] == ["r4", "-1"]
    assert ad.wildcards(ad.cut_adapters(frame(spark, [("TTACTG", "IIIIII")]), [ad.parse("w=ACNG")]), [ad.parse("w=ACNG")]).first().bases == "T"


def test_filters(spark):
    r = mo.prepared(frame(spark, [("AN", "II"), ("ACGTACGT", "I" * 8), ("", ""), ("nNNA", "IIII")]))
    kept = lambda p: [x.read_idx for x in r.where(~filters.single(p)).orderBy("read_idx").collect()]
    assert kept(filters.too_short(2)) == [1, 2, 4] and kept(filters.too_long(2)) == [1, 3]
    assert kept(filters.n_content(0.5)) == [1, 2, 3] and kept(filters.n_content(2)) == [1, 2, 3]
    routed = filters.route(r, filters.standard_rules(filters.single, minimum=3, max_n=0, discard_untrimmed=True))
    assert [x.dest for x in routed.orderBy("read_idx").collect()] == ["too_short", "untrimmed", "too_short", "max_n"]


def pair_frame(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows, 1)], "read_idx long, s1 string, q1 string, s2 string, q2 string")
    c = F.col
    return df.select("read_idx", pairs.read_struct(F.lit("a/1"), c("s1"), c("q1")).alias("r1"), pairs.read_struct(F.lit("a/2"), c("s2"), c("q2")).alias("r2"))


def test_pairs(spark):
    ins = "GACTTACGGATCCATTGCAA"
    rc = ins[::-1].translate(str.maketrans("ACGT", "TGCA"))
    a1, a2 = ad.Adapter("a1", "TTAGACATAT"), ad.Adapter("a2", "CAGTGGAGTA")
    p = pair_frame(spark, [(ins + a1.sequence, "I" * 30, rc + a2.sequence, "I" * 30), ("ACGT", "IIII", "GGGG", "IIII"), ("", "", "", "")])
    cut = pairs.cut_insert_adapters(p, a1, a2)
    assert [(x.r1.sequence, x.r2.sequence) for x in cut.orderBy("read_idx").collect()] == [(ins, rc), ("ACGT", "GGGG"), ("", "")]
    merged = pairs.merge_overlapping(cut).orderBy("read_idx").collect()
    assert (merged[0].r1.sequence, merged[0].r1.merged, merged[0].r2) == (ins, True, None) and merged[1].r2 is not None
    wrong = "A" if ins[4] != "A" else "C"
    bad = ins[:4] + wrong + ins[5:]
    fixed = pairs.cut_insert_adapters(pair_frame(spark, [(bad + a1.sequence, "I" * 4 + "#" + "I" * 25, rc + a2.sequence, "I" * 30)]), a1, a2, correct="conservative").first()
    assert fixed.r1.sequence == ins and fixed.r1.corrected == 1
    low = pairs.overwrite_low_quality(pair_frame(spark, [("ACGT", "####", "GGCC", "IIII")]), 10, 20, 4).first()
    assert low.r1.sequence == "GGCC" and low.r1.corrected == 1
    any_, both = (p.where(filters.paired(filters.too_short(5), n)).count() for n in (1, 2))
    assert (any_, both) == (2, 2)


def test_overlap_extends(spark):
    whole = "GACTTACGGATCCATTGCAACCGTAGGTAC"
    rc = whole[::-1].translate(str.maketrans("ACGT", "TGCA"))
    p = pair_frame(spark, [(whole[:24], "I" * 24, rc[:24], "H" * 24)])
    got = pairs.merge_overlapping(p, 0.7).first()
    assert got.r1.sequence == whole and len(got.r1.qualities) == 30


def test_plan(spark):
    r = frame(spark, [("ACGTACGTGATTACA", "I" * 15), ("ACGNNNNN", "I" * 8), ("ACGTGGGG", "IIII####")])
    o = TrimOptions(adapters=[("back", "GATTACA")], quality_cutoff=[10], trim_n=True, minimum_length=4)
    out = TrimPlan.of(o).run(r)
    assert [(x.sequence, x.dest) for x in out.orderBy("read_idx").collect()] == [("ACGTACGT", "main"), ("ACG", "too_short"), ("ACGT", "main")]
    assert sum(x.records for x in summary(out).collect()) == 3 and "main" in report(out)
    assert TrimOptions.from_tokens("--minimum-length=5 trim_n=true").minimum_length == 5
    assert TrimOptions(mirna=True).resolved().minimum_length == 16
    for bad in (dict(discard_trimmed=True, discard_untrimmed=True), dict(op_order="X"), dict(aligner="insert")):
        with pytest.raises(ValueError):
            TrimOptions(**bad).resolved()


def test_plan_pairs(spark):
    ins = "GACTTACGGATCCATTGCAA"
    rc = ins[::-1].translate(str.maketrans("ACGT", "TGCA"))
    p = pair_frame(spark, [(ins + "TTAGACATAT", "I" * 30, rc + "CAGTGGAGTA", "I" * 30)])
    o = TrimOptions(adapters=[("back", "TTAGACATAT")], adapters2=[("back", "CAGTGGAGTA")], aligner="insert", quality_cutoff=[10], cut2=[2], merge=True, merge_min_overlap=0.5)
    got = TrimPlan.of(o).run_pairs(p).first()
    assert got.dest == "merged" and got.r1.merged


def test_statistics(spark):
    r = frame(spark, [("ACGT", "IIII"), ("AC", "##"), ("", "")])
    assert {(x.read_length, x.n) for x in qc.length_histogram(r).collect()} == {(4, 1), (2, 1), (0, 1)}
    assert qc.position_bases(r).agg(F.sum("n")).first()[0] == 6
    s = qc.summary(qc.length_histogram(r), "read_length").first()
    assert (s["mean"], s["median"], s["modes"]) == (2.0, 2.0, [0.0, 2.0, 4.0])
    e = error.quality_error_rate(r).first()
    assert e.bases == 6 and abs(e.errors - (4 * 10**-4 + 2 * 10**-0.2)) < 1e-9
    with pytest.raises((PySparkException, Py4JJavaError)):
        qc.tile_qualities(r).collect()


def test_detect(spark):
    core = "GATTACACATGCCATGGA"
    rows = [("ACGTTGCA"[i % 5 :] + core + "TGCATCGGATCCTAGC"[i % 7 : i % 7 + 6], None) for i in range(35)]
    r = frame(spark, rows)
    found = detect.detect(r, [("core", core)])
    assert found and core in found[0].sequence and found[0].known == ("core",)
    assert detect.known_fractions(r, [("core", core)], 12, 0.2).first().reads > 0


FASTQ = "@r1 x\nACGT\n+\nIIII\n@r2\n\n+r2\n\n@r3\nAC\n+\n@I\n"


def test_fastq(spark, tmp_path):
    for name, opener in (("a.fastq", open), ("a.fastq.gz", gzip.open), ("a.fq.bz2", bz2.open), ("a.fastq.xz", lzma.open)):
        path = tmp_path / name
        with opener(path, "wb") as f:
            f.write(FASTQ.encode())
        got = records.open_reads(spark, str(path)).orderBy("read_idx").collect()
        assert [(x.read_idx, x.name, x.name2, x.sequence, x.qualities) for x in got] == [(1, "r1 x", "", "ACGT", "IIII"), (2, "r2", "r2", "", ""), (3, "r3", "", "AC", "@I")]
    dos = tmp_path / "dos.fastq"
    dos.write_bytes(FASTQ.replace("\n", "\r\n").encode())
    assert [x.sequence for x in records.read_fastq(spark, str(dos)).orderBy("read_idx").collect()] == ["ACGT", "", "AC"]


def test_fastq_splits(spark, tmp_path):
    path = tmp_path / "long.fastq"
    path.write_text("".join(f"@r{i}\n{'ACGT' * (i % 7)}\n+\n{'@I+I' * (i % 7)}\n" for i in range(1, 400)))
    whole = records.read_fastq(spark, str(path)).orderBy("read_idx").collect()
    split = records.read_fastq(spark, str(path), split=301).orderBy("read_idx").collect()
    assert len(whole) == 399 and whole == split


@pytest.mark.parametrize("text", ["@r1\nACGT\n+\nIII\n", "@r1\nACGT\n", "r1\nACGT\n+\nIIII\n", "@r1\nACGT\n+r2\nIIII\n"])
def test_bad_fastq(spark, tmp_path, text):
    path = tmp_path / "bad.fastq"
    path.write_text(text)
    with pytest.raises((PySparkException, Py4JJavaError)):
        records.read_fastq(spark, str(path)).collect()


def test_fasta_qual_sam(spark, tmp_path):
    fa, qual, sam = tmp_path / "a.fasta", tmp_path / "a.qual", tmp_path / "a.sam"
    fa.write_text("# c\n>r1 d\nACG\nT\n\n>r2\nGG\n")
    qual.write_text(">r1\n40 40 2\n2\n>r2\n0 41\n")
    got = records.open_reads(spark, str(fa), qual=str(qual)).orderBy("read_idx").collect()
    assert [(x.name, x.sequence, x.qualities) for x in got] == [("r1 d", "ACGT", "II##"), ("r2", "GG", "!J")]
    row = "{}\t{}\t*\t0\t0\t*\t*\t0\t0\t{}\t{}"
    sam.write_text("@HD\tVN:1.0\n" + "\n".join([row.format("a", 141, "GG", "II"), row.format("a", 77, "ACG", "III")]) + "\n")
    assert records.open_reads(spark, str(sam)).count() == 2
    pair = records.open_reads(spark, str(sam), mates="paired").first()
    assert (pair.r1.sequence, pair.r2.sequence) == ("ACG", "GG")
    assert records.sniff(str(fa)) == "fasta"
    with pytest.raises(RuntimeError):
        records.read_accession(spark, "X1")


def test_pairs_from_files(spark, tmp_path):
    one, two, both = tmp_path / "1.fastq", tmp_path / "2.fastq", tmp_path / "i.fastq"
    one.write_text("@a/1\nAC\n+\nII\n@b/1\nGG\n+\nII\n")
    two.write_text("@a/2\nTT\n+\nII\n@b/2\nCC\n+\nII\n")
    both.write_text("@a/1\nAC\n+\nII\n@a/2\nTT\n+\nII\n")
    got = records.open_reads(spark, str(one), str(two)).orderBy("read_idx").collect()
    assert [(x.r1.sequence, x.r2.sequence) for x in got] == [("AC", "TT"), ("GG", "CC")]
    assert records.open_reads(spark, str(both), interleave=True).first().r2.sequence == "TT"
    two.write_text("@a/2\nTT\n+\nII\n")
    with pytest.raises((PySparkException, Py4JJavaError)):
        records.open_reads(spark, str(one), str(two)).collect()
    two.write_text("@a/2\nTT\n+\nII\n@z/2\nTT\n+\nII\n")
    with pytest.raises((PySparkException, Py4JJavaError)):
        records.open_reads(spark, str(one), str(two)).collect()


def test_sinks(spark, tmp_path):
    r = frame(spark, [("ACGTA", "IIIII"), ("GG", "II")]).withColumn("dest", F.lit("main"))
    out = tmp_path / "out.fastq"
    sinks.write(sinks.records(r.coalesce(1), "fastq").drop("dest"), str(out), ordered=True)
    part = next(out.glob("part-*"))
    assert part.read_text() == "@r1\nACGTA\n+\nIIIII\n@r2\nGG\n+\nII\n"
    assert records.read_fastq(spark, str(part)).count() == 2
    assert [x.value for x in r.select(sinks.fasta(F.col("name"), F.col("sequence"), 2).alias("value")).collect()] == [">r1\nAC\nGT\nA", ">r2\nGG"]
    sinks.write_routed(r, str(tmp_path / "routed"))
    assert (tmp_path / "routed" / "dest=main").is_dir()
    assert sinks.format_for("x.fa.gz", False) == "fasta"
    with pytest.raises(ValueError):
        sinks.format_for("x.fastq", False)


def test_stream(spark, tmp_path):
    frame(spark, [("ACGTACGT", "IIII####"), ("AC", "II")]).write.parquet(str(tmp_path / "in"))
    routed = stream.trim_stream(stream.read_stream(spark, str(tmp_path / "in")), TrimOptions(quality_cutoff=[10], minimum_length=3))
    q = stream.write_stream(routed, str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(120)
    assert {(x.dest, x.sequence) for x in spark.read.parquet(str(tmp_path / "out")).collect()} == {("main", "ACGT"), ("too_short", "AC")}
