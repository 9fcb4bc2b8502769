"""Error rates: from the qualities, and by shadow regression on reads that differ from frequent ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions import dna


def quality_error_rate(reads: DataFrame, base: int = 33, max_bases: int | None = None, by: str | None = None) -> DataFrame:
    """bases, errors and rate, over the first max_bases of each read. Reads are summed up as decimals, since a sum of
    doubles depends on their order."""
    q = F.col("qualities") if max_bases is None else F.substring("qualities", 1, max_bases)
    group = reads.select(*([by] if by else []), F.length(q).cast("long").alias("n"), dna.error_sum(q, base).cast("decimal(38,22)").alias("e")).groupBy(*([by] if by else []))
    errors = F.sum("e").cast("double")
    return group.agg(F.sum("n").alias("bases"), errors.alias("errors"), (errors / F.sum("n")).alias("error_rate"))


def usable_read_counts(reads: DataFrame) -> DataFrame:
    """sequence, n: distinct reads without N that are no homopolymer."""
    return reads.where(~F.col("sequence").rlike("N|^(.)\\1*$") & (F.length("sequence") > 0)).groupBy("sequence").agg(F.count(F.lit(1)).alias("n"))


def shadow_error_rate(reads: DataFrame) -> DataFrame:
    """Error rate per base from a line through the origin: shadows (reads one mismatch away) on counts, over all usable reads.

    Reads that differ in one base share one key, the read with that base masked. With sum s and sum of squares q of the
    counts under a key, the products of a read's count and its shadows add up to s * s - q over all keys, so no pair is
    ever made. bases, slope, error_rate.
    """
    counts = usable_read_counts(reads)
    n = F.col("n").cast("double")
    whole = counts.agg(F.sum(F.length("sequence")).alias("bases"), F.avg(F.length("sequence")).alias("length"), F.sum(n * n).alias("squares"))
    at = counts.select("sequence", n.alias("n"), F.explode(F.sequence(F.lit(1), F.length("sequence"))).alias("i"))
    key = F.xxhash64(F.length("sequence"), "i", F.expr("concat(substr(sequence, 1, i - 1), '*', substr(sequence, i + 1))"))
    by = at.select(key.alias("key"), "n").groupBy("key").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"))
    pairs = by.agg(F.coalesce(F.sum(F.col("s") * F.col("s") - F.col("q")), F.lit(0.0)).alias("products"))
    slope = F.col("products") / F.col("squares")
    rate = F.lit(1.0) - F.pow(F.lit(1.0) / (F.lit(1.0) + slope), F.lit(1.0) / F.col("length"))
    return whole.crossJoin(pairs).select("bases", slope.alias("slope"), rate.alias("error_rate"))
