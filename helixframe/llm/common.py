"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.storage import shared_dir, stored

__all__ = ["WORD", "crc_mod", "free_names", "hot_join", "read_table", "shared_dir", "slices", "stored"]

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each behind as many underscores as it takes to clash with no column of df, however spelt."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        out.append(n)
    return out


#: Rows of a key above which it is joined by a broadcast, and how many such keys are broadcast at most (of about 50 bytes).
HOT, HOT_KEYS = 20_000, 500_000


def hot_join(left: DataFrame, right: DataFrame, key: str, count: str, how: str = "inner") -> DataFrame:
    """left.join(right, key, how), inner or left; right has one row for each key, with the count of its rows in left. Keys of
    very many rows are broadcast, so that their rows aren't gathered; beyond HOT_KEYS of these, which then have HOT rows each,
    all shuffle."""
    hot = right.where(F.col(count) > HOT)
    n = hot.limit(HOT_KEYS + 1).count()
    if not 0 < n <= HOT_KEYS:
        return left.join(right, key, how)
    cold = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right.where(F.col(count) <= HOT), key, how)
    return left.join(F.broadcast(hot), key).unionByName(cold)


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id as decimal text, modulo n; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def slices(batch: pa.RecordBatch, column: int, most: int = 8 << 20, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts in a column have some megabytes together, or that are one row."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(size):
        if i > start and (total + n > most or i - start >= rows):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)
