"""Contaminant detection: known sequences by k-mers, unknown ones by growing frequent k-mers."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions import dna
from helixframe.operators import growth
from helixframe.storage import fresh, removed

#: Reads that a detector looks at by default, up to which it uses the heuristic, and rows that a report holds.
MAX_READS, HEURISTIC_READS, TOP = 10_000, 50_000, 20
#: K-mers of known sequences that are broadcast at most (about 60 bytes each); beyond, the join shuffles.
BROADCAST_KMERS = 200_000
#: Reads of a part that a frequent k-mer is in at least, for the parts to be searched by themselves.
LEAST_IN_PART = 8


def kmers(seq: Column, k: int) -> Column:
    """All k-mers in order."""
    at = lambda s: F.sequence(F.lit(1), F.greatest(F.length(s) - k + 1, F.lit(1)))
    return dna.let(seq, lambda s: F.when(F.length(s) >= k, F.transform(at(s), lambda i: F.substring(s, i, F.lit(k)))).otherwise(F.array().cast("array<string>")))


def prefiltered(reads: DataFrame, k: int = 12) -> DataFrame:
    """sequence: distinct reads of some complexity, cut where they run past the insert's end, of k bases at least."""
    seq = F.regexp_replace(F.regexp_replace("sequence", "A{8,}.*", ""), "A{2,}$", "")
    rows = reads.where(dna.complexity(F.col("sequence")) > 1.0).select(seq.alias("sequence"))
    return rows.where(F.length("sequence") >= k).distinct()


def kmer_counts(reads: DataFrame, k: int) -> DataFrame:
    """kmer, n: exact counts over all reads."""
    return reads.select(F.explode(kmers(F.col("sequence"), k)).alias("kmer")).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


def detector_for(include: str, reads: int) -> str:
    return "known" if include == "known" else "heuristic" if reads <= HEURISTIC_READS else "kmer"


def least_known(reads: int, length: int, contaminants: list[tuple[str, str]], over: float = 100.0) -> int:
    """How many reads a known contaminant needs: over times what chance gives the shortest of them."""
    k = min(len(s) for _, s in contaminants)
    return ceil(reads * (length - k + 1) * over / 4**k)


def frequent_known(reads: DataFrame, contaminants: list[tuple[str, str]], n_reads: int, length: int, k: int = 12, over: float = 100.0) -> DataFrame:
    """kmer, n: k-mers over the threshold of counting alone, over times ceil(reads * windows / 4^k); exact counts of distinct
    reads' k-mers instead of a sketch's. With contaminants only theirs, of either strand."""
    counts = kmer_counts(reads.select("sequence").distinct(), k).where(F.col("n") >= ceil(n_reads * (length - k + 1) / 4**k) * over)
    if not contaminants:
        return counts
    back = lambda s: s.translate(str.maketrans(dna.IUPAC, dna.COMPLEMENT))[::-1]
    known = sorted({x[i : i + k] for _, s in contaminants for x in (s, back(s)) for i in range(len(x) - k + 1)})
    table = reads.sparkSession.createDataFrame([(x,) for x in known], "kmer string")
    return counts.join(F.broadcast(table) if len(known) <= BROADCAST_KMERS else table, "kmer", "left_semi")


def known_fractions(reads: DataFrame, contaminants: list[tuple[str, str]], k: int = 12, least: float = 0.5) -> DataFrame:
    """name, reads, kmer_fraction: distinct reads of which more than a share of k-mers lies in a contaminant or its
    reverse complement, and the contaminant's best share. An equi-join on k-mers; the known side is a parameter."""
    spark = reads.sparkSession
    rows = []
    for name, seq in contaminants:
        back = seq.translate(str.maketrans(dna.IUPAC, dna.COMPLEMENT))[::-1]
        for strand, s in (("+", seq), ("-", back)):
            found = {s[i : i + k] for i in range(len(s) - k + 1)}
            rows += [(name, strand, x, len(found)) for x in sorted(found)]
    known = spark.createDataFrame(rows, "name string, strand string, kmer string, known_kmers int")
    if len(rows) <= BROADCAST_KMERS:
        known = F.broadcast(known)
    own = reads.select("sequence").distinct().where(F.length("sequence") >= k)
    own = own.select(F.xxhash64("sequence").alias("id"), F.reverse("sequence").alias("s"), F.array_distinct(kmers(F.col("sequence"), k)).alias("ks"))
    # A read is known by two hashes from here on: its text would travel with each of its k-mers.
    hit = own.select("id", F.xxhash64("s").alias("id2"), F.size("ks").alias("m"), F.explode("ks").alias("kmer")).join(known, "kmer")
    by = hit.groupBy("id", "id2", "name", "strand").agg(F.count(F.lit(1)).alias("c"), F.max("m").alias("m"), F.max("known_kmers").alias("known"))
    best = by.groupBy("id", "id2", "name").agg(F.max(F.col("c") / F.col("m")).alias("f"), F.max(F.col("c") / F.col("known")).alias("kf"))
    return best.where(F.col("f") > least).groupBy("name").agg(F.count(F.lit(1)).alias("reads"), F.max("kf").alias("kmer_fraction"))


def abundance(reads: DataFrame, candidates: list[str]) -> DataFrame:
    """candidate, n: distinct reads that contain each candidate; one pass, one sum for each."""
    own = reads.select("sequence").distinct()
    sums = [F.sum(F.contains("sequence", F.lit(c)).cast("long")).alias(f"c{i}") for i, c in enumerate(candidates)]
    one = own.agg(*sums) if sums else own.limit(0)
    pairs = F.array(*[F.struct(F.lit(c).alias("candidate"), F.coalesce(F.col(f"c{i}"), F.lit(0)).alias("n")) for i, c in enumerate(candidates)])
    return one.select(F.explode(pairs).alias("x")).select("x.*")


def least_frequent(n: int, length: int, k: int, over: float) -> int:
    """How many reads a k-mer must be in more than: a share of them, and 100 times what chance gives."""
    return ceil(n * max(over, (length - k + 1) * 100 / 4**k))


def frequent_kmers(reads: DataFrame, k: int = 12, over: float = 0.001, longest: int | None = None) -> list[tuple[str, int]]:
    """Maximal frequent k-mers with counts, longest first.

    k grows from the start size as long as k-mers are more frequent than chance: of length k + 1 only those are counted
    whose first k-mer was frequent. All that is frequent is returned: a read counts once for each of its k-mers, so a size
    has at most (bases a read) / over of them, however many the reads. Two passes find the k-mers of all sizes
    (helixframe.operators.growth). Where a share of a part's reads is hardly one read, a pass for each size does.
    """
    spark = reads.sparkSession
    path = fresh(spark, "distinct-reads")
    try:
        reads.select("sequence").distinct().write.parquet(path)
        own = spark.read.schema("sequence string").parquet(path)
        n, letters, length = own.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("sequence")), F.lit(0)), F.coalesce(F.max(F.length("sequence")), F.lit(0))).first()
        last = longest or length
        if not n or k > min(last, length):
            found = {}
        elif letters < growth.PART_LETTERS or over * growth.PART_LETTERS * n / letters >= LEAST_IN_PART:
            found = _in_two_passes(own.coalesce(max(1, letters // growth.PART_LETTERS)), n, length, k, over, last)
        else:
            found = _size_by_size(own, n, length, k, over, last)
    finally:
        removed(spark, path)
    return sorted(found.items(), key=lambda x: (-len(x[0]) * log(max(x[1], 2)), x[0]))


def _in_two_passes(own: DataFrame, n: int, length: int, k: int, over: float, last: int) -> dict[str, int]:
    """Frequent k-mers of distinct reads: what is frequent in any part, counted in all."""
    least = least_frequent(n, length, min(last, length), over)

    def search(batches):
        for p in growth.parts(batches):
            yield pa.RecordBatch.from_pydict({"kmer": pa.array(growth.longest_frequent(p, k, last, least, n), pa.string())})

    trie = growth.Trie([r[0] for r in own.mapInArrow(search, "kmer string").distinct().collect()], k)
    if not trie.texts:
        return {}
    shared = own.sparkSession.sparkContext.broadcast(trie)

    def count(batches):
        total = np.zeros(len(shared.value.depth), np.int64)
        for p in growth.parts(batches):
            total += shared.value.counts(p)
        node = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"node": node, "n": total[node]})

    total = np.zeros(len(trie.depth), np.int64)
    for node, c in own.mapInArrow(count, "node long, n long").groupBy("node").agg(F.sum("n")).collect():
        total[node] = c
    shared.destroy()
    need = np.array([least_frequent(n, length, max(k, i), over) for i in range(int(trie.depth.max()) + 1)])
    frequent = (trie.depth < k) | (total > need[trie.depth])
    for i in range(k + 1, len(need)):
        at = np.flatnonzero(trie.depth == i)
        frequent[at] &= frequent[trie.parent[at]]
    return {trie.word(i): int(total[i]) for i in np.flatnonzero(frequent & (trie.depth >= k))}


def _size_by_size(own: DataFrame, n: int, length: int, k: int, over: float, last: int) -> dict[str, int]:
    """The same by a pass for each size: k-mers are counted after a semi-join with those of the size before."""
    found: dict[str, int] = {}
    layer: dict[str, int] = {}
    while k <= last:
        counts = own.select(F.explode(F.array_distinct(kmers(F.col("sequence"), k))).alias("kmer"))
        if layer:
            known = own.sparkSession.createDataFrame([(x,) for x in layer], "p string")
            known = F.broadcast(known) if len(layer) <= BROADCAST_KMERS else known
            counts = counts.withColumn("p", F.substring("kmer", 1, k - 1)).join(known, "p", "left_semi")
        layer = dict(map(tuple, counts.groupBy("kmer").count().where(F.col("count") > least_frequent(n, length, k, over)).collect()))
        if not layer:
            break
        found.update(layer)
        k += 1
    return found


@dataclass(frozen=True)
class Contaminant:
    sequence: str
    count: int
    known: tuple[str, ...] = ()

    @property
    def score(self) -> float:
        return len(self.sequence) * log(max(self.count, 2))


def merge_substrings(found: list[tuple[str, int]], keep: float = 0.5) -> list[Contaminant]:
    """Drop what a better sequence contains; keep those with a share of the best score at least."""
    out: list[Contaminant] = []
    for c in sorted((Contaminant(s, n) for s, n in found), key=lambda c: (-c.score, c.sequence)):
        if out and c.score < keep * out[0].score:
            break
        if not any(c.sequence in x.sequence or x.sequence in c.sequence for x in out):
            out.append(c)
    return out


def detect(reads: DataFrame, contaminants: list[tuple[str, str]] = (), *, k: int = 12, max_reads: int | None = MAX_READS, include: str = "all", min_frequency: float = 0.001, min_kmer_match: float = 0.5, top: int = TOP) -> list[Contaminant]:
    """The most likely contaminants of the first max_reads reads (None: of all, by the heuristic unless only known ones are
    asked for), best first, with the known sequences they belong to."""
    some = reads if max_reads is None else reads.where(F.col("read_idx") <= max_reads)
    own = prefiltered(some.select("read_idx", "sequence"), k)
    kind = detector_for(include, max_reads or 0)
    if kind == "known":
        seqs = dict(contaminants)
        rows = known_fractions(own, list(contaminants), k, min_kmer_match).collect()
        looked, first = some.agg(F.count(F.lit(1)), F.min_by(F.length("sequence"), "read_idx")).first()
        least = least_known(max_reads or looked, first or 0, list(contaminants)) if contaminants else 0
        found = [Contaminant(seqs[r["name"]], r["reads"], (r["name"],)) for r in rows if r["reads"] >= least]
    else:
        found = merge_substrings(frequent_kmers(own, k, min_frequency))
        named = []
        for c in found:
            back = c.sequence.translate(str.maketrans(dna.IUPAC, dna.COMPLEMENT))[::-1]
            names = tuple(n for n, s in contaminants if c.sequence in s or s in c.sequence or back in s or s in back)
            named.append(Contaminant(c.sequence, c.count, names))
        found = named
        if include == "unknown":
            found = [c for c in found if not c.known]
    return sorted(found, key=lambda c: (-c.score, c.sequence))[:top]


def reported(found: list[Contaminant], min_count: float = 0, min_len: int = 12, min_complexity: float = 1.1, include: str = "all", limit: int | None = TOP) -> list[Contaminant]:
    """What a report shows: frequent, long and varied enough, known or unknown ones only if asked, the best first."""

    def complexity(seq: str) -> float:
        shares = [seq.upper().count(b) / len(seq) for b in "ACGT"] if seq else []
        return -sum(f * log(f, 2) for f in shares if f)

    keep = [c for c in found if c.count >= min_count and len(c.sequence) >= min_len and complexity(c.sequence) >= min_complexity and (include == "all" or bool(c.known) == (include == "known"))]
    return sorted(keep, key=lambda c: (-c.score, c.sequence))[:limit]


def detect_pairs(pairs: DataFrame, contaminants: list[tuple[str, str]] = (), **how) -> tuple[list[Contaminant], list[Contaminant]]:
    """Contaminants of first and of second mates, each for themselves. pairs: read_idx, r1, r2."""
    one, two = (pairs.where(F.col(r).isNotNull()).select("read_idx", F.col(f"{r}.sequence").alias("sequence")) for r in ("r1", "r2"))
    return detect(one, contaminants, **how), detect(two, contaminants, **how)


def fasta_lines(found: list[Contaminant]) -> str:
    """Contaminants as FASTA: numbered, with count and the known names."""
    return "".join(f">{i} count={c.count}{' known=' + ','.join(c.known) if c.known else ''}\n{c.sequence}\n" for i, c in enumerate(found, 1))
