"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star-shaped candidate edges.

A document's set holds its distinct five-word shingles (with fewer words: the whole sequence). Sets are equal or similar
by 100 * intersection >= percent * union. Equal sets fall into one class first. Class representatives hash their shingles
once; the hash deals each shingle to a bin that keeps its minimum, and an empty bin borrows from a bin that a universal
hash of (bin, attempt) points to until it finds a full one. Bands of bins name buckets. In a bucket each member gets one
edge, to the hub, so a bucket of m members has m - 1 candidates however hot it is; each band picks hubs by its own order.
Edges are confirmed on the full sets.

A star leaves open the pairs between members that the hub doesn't link. Only where a bucket's members lie in more than one
component after the confirmed edges do these matter. The members of the bucket's largest component needn't meet each
other: the rest is dealt out in blocks of bounded bytes that meet each other and the blocks of the largest, and each task
compares two blocks in place (components, sizes, earlier bands, signatures of large sets, then the full sets). It returns a
spanning forest of the links it finds, never the pairs. So no link between documents that share a bucket is lost, but for
pairs of sets of over 200 shingles that agree in less than half of their bins (see _links()).
Components are found by hanging neighbours on the smallest known id over tables. Hubs, buckets and texts of very many rows
are joined by a broadcast of their own, so that they stay where they are.

Null or empty texts, and texts of white space only, have the empty set: they link with nothing, not with each other.
Ids are integers below 2^61. Rows of one id are one document, linked by each of its texts. Rows without an id are told
apart by their texts; their component_id is the smallest id they reach, null if there is none, and of those with equal texts
all are kept or none. A text of any length is one set, in the memory of one task. Ties don't arise: the smallest id of a
component is kept. An empty table gives an empty table. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import hot_join, slices, stored

SHINGLE, PERCENT = 5, 85
#: A pair at the threshold misses all bands with a chance of (1 - 0.85 ** ROWS) ** BANDS, about 3 in 10 million.
BANDS, ROWS = 32, 6
BINS = BANDS * ROWS
#: Rows and shingles in a block of a bucket that the star leaves open.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1_500_000
#: Edges of a hub that meet one copy of its set.
HUB_EDGES = 2_000
#: Texts of one id that differ, and rows without an id, get numbers from here on.
_SPLIT, _NAMELESS = 1 << 61, 1 << 62

_WORDS: dict[bytes, int] = {}
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that scatters."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text; A-Z count as lower case, as bytes do."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_WORDS) > 500_000:
        _WORDS.clear()
    try:
        ids = [_WORDS[w] for w in words]
    except KeyError:
        for w in words:
            if w not in _WORDS:
                _WORDS[w] = xxhash.xxh3_64_intdigest(w)
        ids = [_WORDS[w] for w in words]
    h = np.array(ids, np.uint64)
    k = min(SHINGLE, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = _mix(out + h[i : len(h) - k + 1 + i] * _STEP[i] + _STEP[(i + 1) % 5])
    return np.unique(out)


_BORROW = _mix(np.arange(BINS, dtype=np.uint64)[:, None] * _STEP[0] + np.arange(1, 4 * BINS + 1, dtype=np.uint64)[None, :] * _STEP[1]) % np.uint64(BINS)
_BORROW = _BORROW.astype(np.int64)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def signature(hashes: np.ndarray) -> np.ndarray:
    """Minimum of each bin, densified; hashes: not empty."""
    deal = _mix(hashes ^ _STEP[2])
    bins = (deal >> np.uint64(32)) % np.uint64(BINS)
    out = np.full(BINS, _NONE, np.uint64)
    np.minimum.at(out, bins.astype(np.int64), deal)
    empty = np.flatnonzero(out == _NONE)
    if len(empty):
        full = out != _NONE
        ok = full[_BORROW[empty]]
        first = ok.argmax(axis=1)
        source = _BORROW[empty, first]
        lost = ~ok[np.arange(len(empty)), first]  # practically never: no attempt met a full bin
        source[lost] = np.flatnonzero(full)[0]
        out[empty] = out[source]
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    """One key for each band."""
    rows = sig.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64) * _STEP[4]
    for i in range(ROWS):
        key = _mix(key + rows[:, i] * _STEP[i % 5] + _STEP[(i + 2) % 5])
    return key.astype(np.int64)


def _sets(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest (of the set: 16 bytes, null if empty), bands, sketch (a byte of each bin)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            n, digest, keys, sketch = [], [], [], []
            for text in batch.column(1):
                s = shingles(text.as_py())
                n.append(len(s))
                if len(s):
                    sig = signature(s)
                    digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                    keys.append(bands(sig))
                    sketch.append((sig & np.uint64(255)).astype(np.uint8).tobytes())
                else:
                    digest.append(None)
                    keys.append(None)
                    sketch.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                names=["doc_id", "n_shingles", "digest", "bands", "sketch"],
            )

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>, sketch binary")


def _shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id, set: the sorted hashes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, rows=256):
                got = [shingles(t.as_py()).view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, pa.list_(pa.int64()))], names=["doc_id", "set"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id bigint, set array<bigint>")


def node_of(doc_id: Column, text: Column) -> Column:
    """The document's number in the graph: its id, or without one a number of its text beyond all ids."""
    return F.coalesce(doc_id.cast("bigint"), F.lit(_NAMELESS) + F.xxhash64(text).bitwiseAND(F.lit(_SPLIT - 1)))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, component (the smallest id that it reaches), for every id on an edge. Edges: any order, no nulls.

    Large-star, small-star: every id hangs its neighbours on the smallest one it knows, until nothing moves. Rounds grow
    with the logarithm of the longest path; only sums and minima per id are gathered, no component meets in one task.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    now = stored(both.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    seen = None
    while True:
        # Large star: neighbours above u move to the smallest that u knows, itself included.
        all_ = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = all_.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("many"))
        large = hot_join(all_.where("v > u"), low, "u", "many").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: neighbours at or below u move to the smallest.
        large = stored(large, "cc-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("many"))
        small = hot_join(large, low, "u", "many").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "cc")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    got = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return got.unionByName(got.select(F.col("component").alias("id"), "component").distinct())


def _confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The edges (a, b) whose full sets are similar; b is the hub. The set of a hub of many edges is copied, so that some
    thousands of these meet each copy."""
    degree = edges.groupBy("b").agg(F.count(F.lit(1)).alias("many"))
    copies = hot_join(edges, degree, "b", "many").select("a", "b", F.ceil(F.col("many") / HUB_EDGES).alias("copies"))
    salted = copies.select("a", "b", F.pmod(F.xxhash64("a", F.lit(5)), F.col("copies")).alias("copy"))
    hubs = degree.select("b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("many") / HUB_EDGES) - 1)).alias("copy"))
    hubs = hubs.join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("sb")), "b")
    left = salted.join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("sa")), "a")
    both = left.join(hubs, ["b", "copy"])
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def _links(percent: int):
    """For groups of open buckets: (a, b), a spanning forest of the links between the blocks of each bucket."""
    # Large sets that are similar agree in more than half of that share of their bins; the chance that they don't is below
    # 10 ** -20 for 100 independent bins. Small sets fill few bins, so that theirs hang together: they are always compared.
    least, large = int(BINS * percent / 200), 200

    def bucket(pdf: pd.DataFrame) -> list[tuple[int, int]]:
        rep, c, n, block = (pdf[k].to_numpy() for k in ("rep", "c", "n", "block"))
        cross = pdf["i"].iloc[0] != pdf["j"].iloc[0]
        bands = np.stack(pdf["bands"].to_numpy())
        sketch = np.stack([np.frombuffer(bytes(x), np.uint8) for x in pdf["sketch"]])
        here = int(pdf["band"].iloc[0])
        sets = pdf["set"].to_numpy()
        above = list(range(len(rep)))

        def top(x: int) -> int:
            while above[x] != x:
                above[x] = above[above[x]]
                x = above[x]
            return x

        found = []
        for x in range(len(rep)):
            ok = (c[x + 1 :] != c[x]) & (100 * np.minimum(n[x + 1 :], n[x]) >= percent * np.maximum(n[x + 1 :], n[x]))
            if cross:
                ok &= block[x + 1 :] != block[x]
            others = x + 1 + np.flatnonzero(ok)
            if not len(others):
                continue
            # A pair counts in the first band that it shares.
            others = others[~(bands[others, :here] == bands[x, :here]).any(axis=1)]
            others = others[(n[others] <= large) | (n[x] <= large) | ((sketch[others] == sketch[x]).sum(axis=1) >= least)]
            for y in others:
                if top(x) != top(y):
                    common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if 100 * common >= percent * (n[x] + n[y] - common):
                        found.append((min(rep[x], rep[y]), max(rep[x], rep[y])))
                        above[top(x)] = top(y)
        return found

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [e for _, part in pdf.groupby(["key", "i", "j"], sort=False) for e in bucket(part)]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return group


def _rest(member: DataFrame, comp: DataFrame, classes: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The links that the stars left open: see _links()."""
    tagged = stored(member.join(comp, F.col("rep") == F.col("id"), "left").select("key", "band", "rep", "n", F.coalesce("component", "rep").alias("c")), "nd-tagged")
    parts = tagged.groupBy("key", "c").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s"))
    spread = parts.groupBy("key").agg(F.max(F.struct("m", "s", "c")).alias("top"), F.count(F.lit(1)).alias("kinds"), F.sum("m").alias("m"), F.sum("s").alias("s"))
    blocks = lambda m, s: F.ceil(F.greatest(m / F.lit(BLOCK_ROWS), s / F.lit(BLOCK_SHINGLES)))
    # Two members have met as hub and member.
    spread = spread.where("kinds > 1 and m > 2").select("key", "m", F.col("top.c").alias("largest"), blocks(F.col("m"), F.col("s")).alias("blocks"), blocks(F.col("m") - F.col("top.m"), F.col("s") - F.col("top.s")).alias("rest"), blocks(F.col("top.m"), F.col("top.s")).alias("tops"))
    rows = stored(hot_join(tagged, spread, "key", "m"), "nd-open")
    total = rows.agg(F.sum("n")).first()[0]
    if total is None:
        return None
    # Small buckets share groups of about a block's size. Of a larger one, each block outside the largest component meets
    # each other block in a group of its own; the largest component's blocks come last and don't meet each other.
    groups = -(-int(total) // BLOCK_SHINGLES) * 4
    one, top = F.col("blocks") <= 1, F.col("c") == F.col("largest")
    spot = lambda n: F.pmod(F.xxhash64("rep", F.lit(3)), n)
    block = F.when(one, F.lit(0)).when(top, F.col("rest") + spot(F.col("tops"))).otherwise(spot(F.col("rest")))
    last = F.when(one, F.lit(0)).when(top, F.col("rest") - 1).otherwise(F.col("rest") + F.col("tops") - 1)
    rows = rows.withColumn("block", block.cast("bigint")).withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))))
    rows = rows.withColumn("i", F.least("block", "k")).withColumn("j", F.greatest("block", "k"))
    g = F.when(one, F.pmod(F.xxhash64("key"), F.lit(groups))).otherwise(F.xxhash64("key", "i", "j"))
    rows = rows.select(g.alias("g"), "key", "band", "rep", "n", "c", "block", "i", "j")
    rows = rows.join(classes.select("rep", "bands", "sketch"), "rep").join(full.withColumnRenamed("doc_id", "rep"), "rep")
    return rows.groupBy("g").applyInPandas(_links(percent), "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """node, n_shingles, component for every document: see node_of(); component is the smallest node of its component."""
    slim = docs.select(node_of(docs["doc_id"], docs["text"]).alias("doc_id"), docs["text"].alias("text"))
    # Texts of one id are nodes of their own, with an edge to the id.
    several = slim.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b")).where("a <> b").select("doc_id")
    split = None
    if several.limit(1).count():
        several = stored(several, "nd-several").withColumn("several", F.lit(True))
        number = F.lit(_SPLIT) + F.xxhash64("doc_id", "text").bitwiseAND(F.lit(_SPLIT - 1))
        slim = slim.join(several, "doc_id", "left").select(F.when(F.col("several"), number).otherwise(F.col("doc_id")).alias("doc_id"), "text", F.when(F.col("several"), F.col("doc_id")).alias("own"))
        split = stored(slim.where("own is not null").select(F.col("doc_id").alias("a"), F.col("own").alias("b")).distinct(), "nd-split")
    sets = stored(_sets(slim), "nd-sets")
    one = F.min_by(F.struct("bands", "sketch"), "doc_id").alias("one")
    classes = sets.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.count(F.lit(1)).alias("many"), one)
    classes = stored(classes.select("digest", "rep", "n", "many", "one.*"), "nd-classes")
    member = classes.select("rep", "n", F.posexplode("bands").alias("band", "key"))
    # Buckets of one are gone before anything is joined or stored. The hub is the smallest id: most buckets of a group of
    # copies agree on it, so that their edges are the same.
    hubs = member.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("rep", "n")).alias("hub")).where("m > 1")
    member = stored(hot_join(member, hubs, "key", "m").drop("m"), "nd-members")
    touched = member.select(F.col("rep").alias("doc_id")).distinct()
    full = stored(_shingle_sets(slim.join(touched, "doc_id", "left_semi")).distinct(), "nd-full")
    near = member.where("rep <> hub.rep").where(F.least("n", "hub.n") * 100 >= F.greatest("n", "hub.n") * percent)
    edges = stored(near.select(F.col("rep").alias("a"), F.col("hub.rep").alias("b")).distinct(), "nd-edges")
    good = stored(_confirmed(edges, full, percent).distinct(), "nd-good")
    good = good if split is None else good.unionByName(split)
    comp = stored(components(good), "nd-comp")
    more = _rest(member.drop("hub"), comp, classes, full, percent)
    if more is not None:
        comp = stored(components(good.unionByName(more)), "nd-comp")
    by_class = classes.select("digest", "rep", "many").join(comp, F.col("rep") == F.col("id"), "left").select("digest", "many", F.coalesce("component", "rep").alias("component"))
    linked = hot_join(sets.where(F.col("digest").isNotNull()), by_class, "digest", "many").select(F.col("doc_id").alias("node"), "n_shingles", "component")
    # Empty sets share no key that they could meet under.
    out = linked.unionByName(sets.where(F.col("digest").isNull()).select(F.col("doc_id").alias("node"), "n_shingles", F.col("doc_id").alias("component")))
    if split is None:
        return out
    whole = split.join(comp, F.col("b") == F.col("id")).select("a", "b", F.col("component").alias("of"))
    out = out.join(whole, F.col("node") == F.col("a"), "left")
    return out.select(F.coalesce("b", "node").alias("node"), "n_shingles", F.coalesce("of", "component").alias("component"))


def query(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document."""
    named = lambda c: F.when(F.col(c) < _SPLIT, F.col(c))
    return near_duplicates(docs).select(named("node").alias("doc_id"), "n_shingles", named("component").alias("component_id"), (F.col("node") == F.col("component")).alias("kept"))
