"""Sinks: records as text, routed, demultiplexed, interleaved or in two files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fasta(name: Column, seq: Column, width: int | None = None) -> Column:
    """One record; lines of width bases."""
    text = F.regexp_replace(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), "\n$", "") if width else seq
    return F.concat(F.lit(">"), name, F.lit("\n"), text)


def fastq(name: Column, seq: Column, quals: Column, name2: Column | None = None) -> Column:
    """One record; an error without qualities."""
    q = F.when(quals.isNull(), F.raise_error(F.lit("FASTQ needs qualities"))).otherwise(quals)
    return F.concat(F.lit("@"), name, F.lit("\n"), seq, F.lit("\n+"), name2 if name2 is not None else F.lit(""), F.lit("\n"), q)


def colorspace_fasta(name: Column, primer: Column, seq: Column) -> Column:
    return fasta(name, F.concat(F.coalesce(primer, F.lit("")), seq))


def colorspace_fastq(name: Column, primer: Column, seq: Column, quals: Column) -> Column:
    return fastq(name, F.concat(F.coalesce(primer, F.lit("")), seq), quals)


def format_for(path: str, has_qualities: bool) -> str:
    """fasta or fastq by the path's ending, else by whether there are qualities."""
    from helixframe.sources.records import guess_format

    kind = guess_format(path)
    if kind == "fastq" and not has_qualities:
        raise ValueError("FASTQ needs qualities")
    return kind if kind in ("fasta", "fastq") else "fastq" if has_qualities else "fasta"


def records(reads: DataFrame, kind: str, prefix: str = "") -> DataFrame:
    """read_idx and value: the text of each read."""
    c = lambda n: F.col(f"{prefix}{n}")
    text = fasta(c("name"), c("sequence")) if kind == "fasta" else fastq(c("name"), c("sequence"), c("qualities"))
    return reads.select(*[x for x in ("dest", "read_idx") if x in reads.columns], text.alias("value"))


def write(rows: DataFrame, path: str, ordered: bool = False, compression: str | None = None, by: str | None = None) -> None:
    """Text files: part files in parallel; in input order if asked; a folder for each value of by."""
    rows = rows.orderBy("read_idx") if ordered else rows
    writer = rows.select("value", *([by] if by else [])).write.mode("overwrite")
    if compression:
        writer = writer.option("compression", compression)
    (writer.partitionBy(by) if by else writer).text(path)


def write_routed(reads: DataFrame, path: str, kind: str = "fastq", **how) -> None:
    """One folder for each dest."""
    write(records(reads, kind), path, by="dest", **how)


def demultiplexed(reads: DataFrame) -> DataFrame:
    """dest: the adapter's name for reads that no filter took, unknown for those without."""
    return reads.withColumn("dest", F.when(F.col("dest") != "main", F.col("dest")).otherwise(F.coalesce("adapter_name", F.lit("unknown"))))


def interleaved_records(pairs: DataFrame, kind: str = "fastq") -> DataFrame:
    """Both mates in turn; a merged pair has one."""
    one, two = records(pairs, kind, "r1."), records(pairs.where(F.col("r2").isNotNull()), kind, "r2.")
    both = one.withColumn("mate", F.lit(1)).unionByName(two.withColumn("mate", F.lit(2)))
    return both.select(*[x for x in ("dest",) if x in both.columns], (F.col("read_idx") * 2 + F.col("mate")).alias("read_idx"), "value")


def rest_lines(rest: DataFrame) -> DataFrame:
    return rest.select("read_idx", F.concat_ws(" ", "rest", "name").alias("value"))


def info_lines(info: DataFrame) -> DataFrame:
    return info.select("read_idx", F.array_join("fields", "\t").alias("value"))


def wildcard_lines(bases: DataFrame) -> DataFrame:
    return bases.select("read_idx", F.concat_ws(" ", "bases", "name").alias("value"))


def write_pairs(pairs: DataFrame, path1: str, path2: str, kind: str = "fastq", **how) -> None:
    """Two folders of files, both in input order, so that the n-th records of the two are mates. Pairs whose second mate is
    gone belong elsewhere: route them first."""
    both = pairs.where(F.col("r2").isNotNull())
    write(records(both, kind, "r1."), path1, ordered=True, **how)
    write(records(both, kind, "r2."), path2, ordered=True, **how)


def write_all(reads: DataFrame, path: str, dests: list[str], kind: str = "fastq", **how) -> None:
    """As write_routed(), with a folder for each of dests even if it gets no read."""
    write_routed(reads, path, kind, **how)
    jvm = reads.sparkSession._jvm
    for dest in dests:
        p = jvm.org.apache.hadoop.fs.Path(f"{path}/dest={dest}/_EMPTY")
        fs = p.getFileSystem(reads.sparkSession.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(p.getParent()):
            fs.create(p, True).close()
