"""Modifiers: projections over single reads.

A frame of single reads has the columns read_idx, name, sequence, qualities (null if there are none) and bookkeeping:
clipped (front and back before a match, front and back after it), adapter_name (null without a match) and matches (one
struct per removed adapter). Modifiers keep all other columns.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions import dna

MATCH = "struct<adapter:string,front:boolean,astart:int,astop:int,rstart:int,rstop:int,matches:int,errors:int,length:int,adjacent:string,sequence:string,qualities:string>"

Modifier = Callable[[DataFrame], DataFrame]


def prepared(reads: DataFrame) -> DataFrame:
    """Reads with the bookkeeping columns that modifiers need."""
    if "clipped" not in reads.columns:
        reads = reads.withColumn("clipped", F.array(*[F.lit(0)] * 4))
    if "adapter_name" not in reads.columns:
        reads = reads.withColumn("adapter_name", F.lit(None).cast("string"))
    if "matches" not in reads.columns:
        reads = reads.withColumn("matches", F.array().cast(f"array<{MATCH}>"))
    return reads


def clip(reads: DataFrame, keep: Column) -> DataFrame:
    """Keep [start, stop) of sequence and qualities; what goes adds to clipped, before or after a match. keep: a struct
    (see dna.bounds()); null keeps all."""
    n = F.length("sequence")
    bounded = reads.withColumn("_keep_", F.coalesce(keep, F.struct(F.lit(0).alias("start"), n.alias("stop"))))
    a, b = F.col("_keep_.start"), F.col("_keep_.stop")
    # An empty rest counts as cut from the back.
    gone = [F.when(b <= a, F.lit(0)).otherwise(a), F.when(b <= a, n).otherwise(n - b)]
    after = F.col("adapter_name").isNotNull()
    clipped = F.array(*[F.col("clipped")[i] + F.when(after == (i >= 2), gone[i % 2]).otherwise(F.lit(0)) for i in range(4)])
    out = bounded.withColumns({"clipped": clipped, "sequence": dna.slice_(F.col("sequence"), a, b), "qualities": dna.slice_(F.col("qualities"), a, b)})
    return out.drop("_keep_")


def cutter(lengths: Sequence[int]) -> Modifier:
    return lambda r: clip(r, dna.cut(F.col("sequence"), list(lengths)))


def quality_trimmer(front: int = 0, back: int = 10, base: int = 33) -> Modifier:
    """Reads without qualities pass."""
    return lambda r: clip(r, F.when(F.col("qualities").isNotNull(), dna.quality_trim(F.col("qualities"), front, back, base)))


def nextseq_trimmer(cutoff: int, base: int = 33) -> Modifier:
    """Reads without qualities pass."""
    return lambda r: clip(r, F.when(F.col("qualities").isNotNull(), dna.nextseq_trim(F.col("sequence"), F.col("qualities"), cutoff, base)))


def n_end_trimmer() -> Modifier:
    return lambda r: clip(r, dna.n_end_trim(F.col("sequence")))


def min_cutter(lengths: Sequence[int], count_trimmed: bool = True, only_trimmed: bool = False) -> Modifier:
    """Cuts only the shortfall. count_trimmed: bases that adapters took count too; only_trimmed: reads with a match only,
    and only at ends where a match was."""

    def apply(reads: DataFrame) -> DataFrame:
        c, m = F.col("clipped"), F.col("matches")
        removed = lambda front: F.aggregate(F.filter(m, lambda x: x["front"] == F.lit(front)), F.lit(0), lambda a, x: a + F.when(x["front"], x["rstop"]).otherwise(x["length"] - x["rstart"]))
        matched = F.col("adapter_name").isNotNull()
        done = []
        for i, front in enumerate((True, False)):
            done.append(c[i] + c[i + 2] + removed(front) if count_trimmed else F.when(matched, c[i + 2]).otherwise(c[i]))
        start, stop = dna.min_cut(F.col("sequence"), list(lengths), *done)
        if only_trimmed:
            n = F.length("sequence")
            start = F.when(matched & F.exists(m, lambda x: x["front"]), start).otherwise(F.lit(0))
            stop = F.when(matched & F.exists(m, lambda x: ~x["front"]), stop).otherwise(n)
        return clip(reads, dna.bounds(start, stop))

    return apply


def rrbs_trimmer(trim_5p: int = 0, trim_3p: int = 2) -> Modifier:
    """2 bases off the 3' end of reads that lost an adapter there."""
    return min_cutter([x for x in (trim_5p, -trim_3p) if x], count_trimmed=False, only_trimmed=True)


def non_directional_bisulfite_trimmer(trim_5p: int = 2, trim_3p: int = 2, rrbs: bool = False) -> Modifier:
    """CAA or CGA at the front: trim_5p bases off it; otherwise, for RRBS, the RRBS cut."""

    def apply(reads: DataFrame) -> DataFrame:
        hit = F.col("sequence").rlike("^C[AG]A")
        n = F.length("sequence")
        stop = n
        if rrbs:
            back = F.col("adapter_name").isNotNull() & F.exists("matches", lambda x: ~x["front"])
            missing = F.greatest(F.lit(trim_3p) - F.col("clipped")[3], F.lit(0))
            stop = F.when(~hit & back, F.greatest(n - missing, F.lit(0))).otherwise(n)
        return clip(reads, dna.bounds(F.when(hit, F.least(F.lit(trim_5p), n)).otherwise(F.lit(0)), stop))

    return apply


def truseq_bisulfite_trimmer() -> Modifier:
    return min_cutter([6], count_trimmed=True)


def swift_bisulfite_trimmer(read: int, trim: int = 10) -> Modifier:
    """trim bases off read 1's 3' end, or read 2's 5' end."""
    return min_cutter([-trim] if read == 1 else [trim], count_trimmed=False)


def length_tagger(tag: str) -> Modifier:
    return lambda r: r.withColumn("name", dna.length_tag(F.col("name"), F.col("sequence"), tag))


def suffix_remover(suffixes: Sequence[str]) -> Modifier:
    return lambda r: r.withColumn("name", dna.strip_suffixes(F.col("name"), list(suffixes)))


def prefix_suffix_adder(prefix: str = "", suffix: str = "") -> Modifier:
    return lambda r: r.withColumn("name", dna.add_prefix_suffix(F.col("name"), prefix, suffix, F.col("adapter_name")))


def double_encoder() -> Modifier:
    return lambda r: r.withColumn("sequence", dna.double_encode(F.col("sequence")))


def zero_capper(base: int = 33) -> Modifier:
    return lambda r: r.withColumn("qualities", dna.zero_cap(F.col("qualities"), base))


def primer_trimmer() -> Modifier:
    """Drops the first colour and blanks the primer."""

    def apply(reads: DataFrame) -> DataFrame:
        out = clip(reads, dna.bounds(F.least(F.lit(1), F.length("sequence")), F.length("sequence")))
        return out.withColumn("primer", F.lit("")) if "primer" in reads.columns else out

    return apply


def chain(reads: DataFrame, modifiers: Sequence[Modifier]) -> DataFrame:
    """All modifiers in order."""
    for m in modifiers:
        reads = m(reads)
    return reads


def chain_pairs(pairs: DataFrame, first: Sequence[Modifier], second: Sequence[Modifier]) -> DataFrame:
    """Modifiers over r1 and r2 of a frame of pairs (columns read_idx, r1, r2); [] leaves a mate as it is (legacy mode)."""
    for mate, modifiers in (("r1", first), ("r2", second)):
        if modifiers:
            keep = [c for c in pairs.columns if c != mate]
            inner = pairs.schema[mate].dataType.names
            flat = pairs.select(F.struct(*keep).alias("_keep"), F.col(mate).isNull().alias("_null"), f"{mate}.*")
            flat = chain(prepared(flat), modifiers)
            names = [c for c in flat.columns if c not in ("_keep", "_null")]
            assert set(inner) <= set(names)
            pairs = flat.select(*[F.col("_keep")[c].alias(c) for c in keep], F.when(~F.col("_null"), F.struct(*names)).alias(mate))
            pairs = pairs.select(*sorted(pairs.columns, key=lambda c: (c in ("r1", "r2"), c)))
    return pairs
