"""Mixing sources to target weights by balanced sampling with the cube method.

Each document of a source is due target / source_size copies. The whole part is taken at once; the fractional part is an
inclusion probability. The flight phase moves probabilities through the null space of two constraints (the documents and
the words drawn) three units at a time, until each unit but two is 0 or 1. It runs on blocks of a source that the hash of
the id deals out; what the blocks leave undecided flies again, in fewer blocks, until one block of a source is left, and
its landing problem of a dozen units is settled by weighing all their samples. Nothing depends on partitions or the order
of rows: reruns agree.

Rows that agree in id, source and text are one class: of its m rows, each due d copies, m times the fraction of d are due
together. The whole part of that is certain and only its fraction is a unit that flies, so a class of any number of rows is
one row throughout, and which of its rows get a copy more doesn't matter.

Null texts and empty texts have size 0 and are taken as any other; a source without words has target 0, and none of its
documents is drawn. Null sources form a source of their own, the last; null ids are ids like others. A text of any length
is its count of words. Ties in the landing go to the first sample. An empty table gives an empty table. Extra columns aren't
read by mix(); mix_rows() keeps all columns, and calls own ones that clash with them mix_<name>.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import WORD, stored

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: What the mix holds, as a share of all words; copies of a document at most.
TOTAL, MOST = 1.5, 2
#: Documents that fly in one block; units of a source that the landing problem holds besides what the flight leaves.
BLOCK, LANDING = 4000, 13
_EPS = 1e-9


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, h (of id and text), size (words of the text)."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    return docs.select("doc_id", "source", F.xxhash64("doc_id", "text").alias("h"), size.alias("size"))


def targets(units: DataFrame, weights=WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """source, source_size, n_units, target: one row per source; units: source, size and m, how many rows a unit stands for.

    With t words for each unit of weight, a source gets min(t * weight, most * size). The t that spends the total lies
    where the sources with the lowest size per weight are full and the rest share what is left, so sorting by that ratio
    and running sums find it: no loop. Only one row per source passes through the windows.
    """
    by = units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count(F.lit(1)).alias("n_units"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    by = by.withColumn("w", F.get(F.array(*[F.lit(float(x)) for x in weights]), (rank - 1) % len(weights)))
    by = by.withColumn("full", F.col("source_size") * float(most)).withColumn("ratio", F.col("full") / F.col("w"))
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumn("goal", F.sum("source_size").over(whole) * float(total)).withColumn("w_all", F.sum("w").over(whole))
    by = by.withColumn("spent", F.coalesce(F.sum("full").over(order), F.lit(0.0))).withColumn("w_left", F.col("w_all") - F.coalesce(F.sum("w").over(order), F.lit(0.0)))
    # t if this source were the first that is not full. It is, if that t stays below its ratio; later ones give less.
    by = by.withColumn("t", (F.col("goal") - F.col("spent")) / F.col("w_left"))
    by = by.withColumn("level", F.max(F.when(F.col("t") <= F.col("ratio"), F.col("t"))).over(whole))
    target = F.least(F.coalesce(F.col("level") * F.col("w"), F.col("full")), F.col("full"))
    return by.select("source", "source_size", "n_units", target.alias("target"))


def _uniform(*key) -> float:
    return int.from_bytes(hashlib.blake2b(repr(key).encode(), digest_size=7).digest(), "big") / 2**56


def flight(p: np.ndarray, size: np.ndarray, keys: list) -> np.ndarray:
    """Move p until two units at most are strictly between 0 and 1, keeping sum(p) and sum(p * size)."""
    p = p.astype(float).copy()
    held: list[int] = []
    for i in range(len(p)):
        if not _EPS < p[i] < 1 - _EPS:
            continue
        held.append(i)
        if len(held) < 3:
            continue
        a, b, c = held
        # Null space of [[1, 1, 1], [sa, sb, sc]]; any direction with sum 0 if all sizes agree.
        u = np.array([size[c] - size[b], size[a] - size[c], size[b] - size[a]], dtype=float)
        if not u.any():
            u = np.array([1.0, -1.0, 0.0])
        u /= np.abs(u).max()
        q = p[held]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > 0, (1 - q) / u, np.where(u < 0, -q / u, np.inf)).min()
            down = np.where(u > 0, q / u, np.where(u < 0, (q - 1) / u, np.inf)).min()
        q = q + u * (up if _uniform("f", keys[a], keys[b], keys[c]) * (up + down) < down else -down)
        q[q < _EPS], q[q > 1 - _EPS] = 0.0, 1.0
        p[held] = q
        held = [j for j in held if 0.0 < p[j] < 1.0]
    return p


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Settle the units that are left, LANDING + 2 at most: of all their samples, the one whose words miss least.

    Samples that miss the documents by more than one pay for it with the mean size; ties go to the first in order.
    """
    p = p.copy()
    left = np.flatnonzero((p > 0) & (p < 1))
    if not len(left):
        return p
    draws = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
    miss = draws - p[left]
    cost = np.abs(miss @ size[left]) + np.maximum(0, np.abs(miss.sum(1)) - 1) * max(1.0, size.mean())
    p[left] = draws[int(np.round(cost, 6).argmin())]
    return p


def _fly(pdf: pd.DataFrame, last: bool) -> pd.DataFrame:
    # Long documents fly first, in classes of like size and at random within: the many short ones that follow settle
    # them, and what is left to land is short.
    scale = -np.floor(np.log2(pdf["size"].to_numpy(float) + 1))
    pdf = pdf.assign(scale=scale).sort_values(["scale", "h", "size"], kind="stable").drop(columns="scale").reset_index(drop=True)
    keys = [(int(h), i) for i, h in enumerate(pdf["h"])]
    size, p = pdf["size"].to_numpy(float), pdf["p"].to_numpy(float).copy()
    if last:
        # Some units of all sizes wait on the ground: the landing needs them to meet the total.
        fly = np.ones(len(p), bool)
        fly[np.unique(np.linspace(0, len(p) - 1, min(LANDING, len(p))).astype(int))] = False
        at = np.flatnonzero(fly)
        p[at] = flight(p[at], size[at], [keys[i] for i in at])
        return pdf.assign(p=land(p, size))
    return pdf.assign(p=flight(p, size, keys))


def _flies(pdf: pd.DataFrame) -> pd.DataFrame:
    return _fly(pdf, False)


def _lands(pdf: pd.DataFrame) -> pd.DataFrame:
    return _fly(pdf, True)


#: Rows of a class that one task makes at a time, and above which a class joins by itself.
CHUNK, HOT = 10_000, 100_000


def classes(docs: DataFrame, weights=WEIGHTS, total: float = TOTAL, most: float = MOST, block: int = BLOCK) -> DataFrame:
    """doc_id, source, h, size, m, source_size, target, base, extra: one row for each class of m equal rows. Each of these
    is taken base times, and extra of them once more."""
    units = sized(docs).groupBy("doc_id", "source", "h", "size").agg(F.count(F.lit(1)).alias("m"))
    units = stored(units, "mix-units")
    goals = stored(targets(units, weights, total, most), "mix-targets")
    # A table of one row per source: joined by the engine's own choice, no forced broadcast.
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = units.join(goals.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.withColumn("due", F.least(due, F.lit(float(most)))).withColumn("base", F.floor(F.col("due") + _EPS))
    rows = rows.withColumn("owed", F.greatest(F.col("due") - F.col("base"), F.lit(0.0)) * F.col("m")).withColumn("extra", F.floor(F.col("owed") + _EPS))
    rows = rows.withColumn("p", F.greatest(F.col("owed") - F.col("extra"), F.lit(0.0))).withColumn("blocks", F.ceil(F.col("n_units") / F.lit(block)))
    # The id passes through pandas as text: a null beside it must not turn it into a float.
    kind = docs.schema["doc_id"].dataType
    slim = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "source", "h", "size", "m", "source_size", "target", "base", "extra", "p", "blocks")
    slim = slim.withColumn("n", F.pmod(F.xxhash64("h", F.lit(7)), F.col("blocks")))
    schema = slim.schema.simpleString()[7:-1].replace(",", ", ").replace(":", " ")
    biggest = goals.agg(F.max("n_units")).first()[0] or 0
    done = []
    while True:
        last = biggest <= block
        flown = slim.groupBy("source", "n").applyInPandas(_lands if last else _flies, schema)
        if last:
            done.append(flown)
            break
        flown = stored(flown, "mix-flown")
        done.append(flown.where((F.col("p") <= 0) | (F.col("p") >= 1)))
        # Each block leaves two units at most; they fly again, block units together.
        slim = flown.where((F.col("p") > 0) & (F.col("p") < 1)).withColumn("n", F.floor(F.col("n") / F.lit(block // 2)))
        biggest = 2 * -(-biggest // block)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    extra = (F.col("extra") + F.round("p")).cast("bigint")
    return out.select(F.col("doc_id").cast(kind).alias("doc_id"), "source", "h", "size", "m", "source_size", "target", F.col("base").cast("bigint").alias("base"), extra.alias("extra"))


def mix(docs: DataFrame, weights=WEIGHTS, total: float = TOTAL, most: float = MOST, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source, source_size, target, copies, taken for each document; copies is 0 to most.

    The rows of a class are made from their number, some thousands in a task."""
    kinds = classes(docs, weights, total, most, block)
    chunk = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("m") - 1) / CHUNK))).alias("chunk")
    few, many = kinds.where(F.col("m") <= CHUNK).withColumn("chunk", F.lit(0).cast("bigint")), kinds.where(F.col("m") > CHUNK).select("*", chunk).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    first = F.col("chunk") * CHUNK
    place = F.explode(F.sequence(first, F.least(first + CHUNK, F.col("m")) - 1)).alias("place")
    rows = few.unionByName(many).select("*", place)
    copies = F.col("base") + (F.col("place") < F.col("extra")).cast("bigint")
    return rows.select("doc_id", "size", "source", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix_rows(docs: DataFrame, **how) -> DataFrame:
    """All columns of docs with source_size, target, size, copies and taken, for each row.

    Rows find their class by id, source and hash; classes of very many rows do so by a broadcast of their own, or as far as
    those are many too by the engine's own splitting. Only where some of a class's rows get a copy more than others its rows
    are numbered: those rows are written down with a number, and counted for each of the writer's parts.
    """
    names = ["size", "source_size", "target", "copies", "taken"]
    own = [n if n.lower() not in {c.lower() for c in docs.columns} else f"mix_{n}" for n in names]
    kinds = stored(classes(docs, **how), "mix-classes").select(*[F.col(c).alias(f"__mix_{c}") for c in ("doc_id", "source", "h", "size", "m", "source_size", "target", "base", "extra")])
    c = lambda n: F.col(f"__mix_{n}")
    on = docs["doc_id"].eqNullSafe(c("doc_id")) & docs["source"].eqNullSafe(c("source")) & (F.xxhash64(docs["doc_id"], docs["text"]) == c("h"))
    rows = docs.join(kinds.where(c("m") <= HOT), on)
    hot = kinds.where(c("m") > HOT)
    n = hot.count()
    if n:
        rows = rows.unionByName(docs.join(F.broadcast(hot) if n <= 100_000 else hot, on))
    copies = c("base") + F.when(c("extra") == c("m"), 1).otherwise(0)
    even = (c("extra") == 0) | (c("extra") == c("m"))
    final = lambda df, x: df.select(*docs.columns, *[v.cast("double" if k.endswith("target") else "bigint").alias(k) for k, v in zip(own, (c("size"), c("source_size"), c("target"), x, x * c("size")))])
    out = final(rows.where(even), copies)
    if kinds.where(~even).limit(1).count():
        some = stored(rows.where(~even).withColumn("__mix_row", F.monotonically_increasing_id()), "mix-uneven")
        by = ["__mix_doc_id", "__mix_source", "__mix_h"]
        some = some.withColumn("__mix_part", F.shiftright("__mix_row", 33))
        parts = some.groupBy(*by, "__mix_part").agg(F.count(F.lit(1)).alias("__mix_n"))
        before = F.coalesce(F.sum("__mix_n").over(Window.partitionBy(*by).orderBy("__mix_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        parts = parts.select(*[F.col(x).alias(f"{x}_") for x in (*by, "__mix_part")], before.alias("__mix_before"))
        rank = F.row_number().over(Window.partitionBy(*by, "__mix_part").orderBy("__mix_row"))
        match = [F.col(x).eqNullSafe(F.col(f"{x}_")) for x in (*by, "__mix_part")]
        ranked = some.withColumn("__mix_rank", rank).join(parts, match)
        out = out.unionByName(final(ranked, c("base") + (F.col("__mix_rank") + F.col("__mix_before") <= c("extra")).cast("bigint")))
    return out
