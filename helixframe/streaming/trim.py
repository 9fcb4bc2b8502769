"""Trimming as a stream: the chain keeps no state, so files are trimmed as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.plans.trim import TrimOptions, TrimPlan

SCHEMA = "read_idx bigint, name string, sequence string, qualities string"


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """Reads from Parquet files that appear in a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def trim_stream(reads: DataFrame, options: TrimOptions) -> DataFrame:
    return TrimPlan.of(options).run(reads)


def write_stream(routed: DataFrame, path: str, checkpoint: str):
    """Parquet by dest, exactly once by the checkpoint; returns the query."""
    rows = routed.select("dest", "read_idx", "name", "sequence", "qualities")
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("dest").trigger(availableNow=True).start()


def counts(routed: DataFrame) -> DataFrame:
    """Running reads and bases per dest."""
    return routed.groupBy("dest").agg(F.count(F.lit(1)).alias("records"), F.sum(F.length("sequence")).alias("bp"))
