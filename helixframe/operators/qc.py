"""Quality-control statistics as aggregations with partial sums; positions are 1-based."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions import dna

#: The tile is the fifth field of the name.
TILE = r"^(?:[^:]+:){4}([^:]+)"


def totals(reads: DataFrame, by: str = "source") -> DataFrame:
    """Records and bases for each value of a column."""
    return reads.groupBy(by).agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.sum(F.length("sequence")), F.lit(0)).alias("bp"))


def histogram(reads: DataFrame, value: Column, name: str) -> DataFrame:
    """Counts of a value's values. Nulls go after the counting: a filter below would compute the value twice."""
    return reads.groupBy(value.alias(name)).agg(F.count(F.lit(1)).alias("n")).where(F.col(name).isNotNull())


def length_histogram(reads: DataFrame) -> DataFrame:
    return histogram(reads, F.length("sequence"), "read_length")


def gc_histogram(reads: DataFrame) -> DataFrame:
    return histogram(reads, dna.gc_percent(F.col("sequence")), "gc")


def quality_histogram(reads: DataFrame, base: int = 33) -> DataFrame:
    return histogram(reads, dna.mean_quality(F.col("qualities"), base), "mean_quality")


def _chars(reads: DataFrame, column: str, *keep: Column) -> DataFrame:
    return reads.select(*keep, F.posexplode(F.filter(F.split(column, ""), lambda c: c != "")).alias("p", "c")).withColumn("position", F.col("p") + 1).drop("p")


def position_bases(reads: DataFrame) -> DataFrame:
    return _chars(reads, "sequence").groupBy("position", F.col("c").alias("base")).agg(F.count(F.lit(1)).alias("n"))


def position_qualities(reads: DataFrame, base: int = 33) -> DataFrame:
    return _chars(reads, "qualities").groupBy("position", (F.ascii("c") - base).alias("quality")).agg(F.count(F.lit(1)).alias("n"))


def tile(name: Column, pattern: str = TILE) -> Column:
    """The tile of a read's name; an error if the name has none."""
    got = F.regexp_extract(name, pattern, 1)
    return F.when(got == "", F.raise_error(F.concat(F.lit("no tile in the name "), name))).otherwise(got)


def tile_qualities(reads: DataFrame, base: int = 33) -> DataFrame:
    """Reads by tile and mean quality."""
    by = reads.groupBy(tile(F.col("name")).alias("tile"), dna.mean_quality(F.col("qualities"), base).alias("mean_quality")).agg(F.count(F.lit(1)).alias("n"))
    return by.where(F.col("mean_quality").isNotNull())


def position_tile_qualities(reads: DataFrame, base: int = 33) -> DataFrame:
    rows = _chars(reads, "qualities", tile(F.col("name")).alias("tile"))
    return rows.groupBy("position", "tile", (F.ascii("c") - base).alias("quality")).agg(F.count(F.lit(1)).alias("n"))


def summary(hist: DataFrame, value: str, n: str = "n") -> DataFrame:
    """Mean, population deviation, median and modes of a histogram."""
    x, c = F.col(value).cast("double"), F.col(n)
    one = hist.agg(
        (F.sum(x * c) / F.sum(c)).alias("mean"),
        F.sqrt(F.greatest(F.sum(x * x * c) / F.sum(c) - F.pow(F.sum(x * c) / F.sum(c), F.lit(2)), F.lit(0.0))).alias("stdev"),
        F.percentile(x, F.lit(0.5), c).alias("median"),
        F.max(c).alias("top"),
        F.collect_list(F.struct(c.alias("c"), x.alias("x"))).alias("all"),
    )
    modes = F.array_sort(F.transform(F.filter("all", lambda e: e["c"] == F.col("top")), lambda e: e["x"]))
    return one.select("mean", "stdev", "median", modes.alias("modes"))
