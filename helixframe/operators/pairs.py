"""Operators over pairs: frames with read_idx, r1 and r2 (structs of name, sequence, qualities and bookkeeping)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from helixframe.functions import dna
from helixframe.operators import kernels
from helixframe.operators.adapters import Adapter, match_batch
from helixframe.operators.modifiers import MATCH

READ = f"struct<name:string,sequence:string,qualities:string,clipped:array<int>,adapter_name:string,matches:array<{MATCH}>,insert_overlap:boolean,merged:boolean,corrected:int>"
PAIR = f"read_idx bigint, r1 {READ}, r2 {READ}"


def read_struct(name: Column, sequence: Column, qualities: Column) -> Column:
    """A read as the pair operators want it."""
    return F.struct(
        name.alias("name"), sequence.alias("sequence"), qualities.alias("qualities"), F.array(*[F.lit(0)] * 4).alias("clipped"), F.lit(None).cast("string").alias("adapter_name"),
        F.array().cast(f"array<{MATCH}>").alias("matches"), F.lit(False).alias("insert_overlap"), F.lit(False).alias("merged"), F.lit(0).alias("corrected"),
    )


def _over_pairs(pairs: DataFrame, work) -> DataFrame:
    """work(list of r1 dicts, list of r2 dicts) changes the reads of a batch in place; r2 may become None."""

    schema = to_arrow_schema(T.StructType.fromDDL(PAIR))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one, two = (batch.column(c).to_pylist() for c in ("r1", "r2"))
                both = [x for x in range(len(one)) if one[x] is not None and two[x] is not None]
                work(one, two, both)
                columns = [batch.column("read_idx"), *(pa.array(r, schema.field(c).type) for c, r in (("r1", one), ("r2", two)))]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return pairs.select("read_idx", "r1", "r2").mapInArrow(rows, PAIR)


def _record(read: dict, adapter: Adapter, astop: int, rstart: int, rstop: int, matches: int, errors: int) -> None:
    s, q = read["sequence"], read["qualities"]
    before = s[rstart - 1] if 0 < rstart <= len(s) and s[rstart - 1] in "ACGT" else ""
    read["matches"].append({"adapter": adapter.name, "front": False, "astart": 0, "astop": astop, "rstart": rstart, "rstop": rstop, "matches": matches, "errors": errors, "length": len(s), "adjacent": before, "sequence": s, "qualities": q})
    read["adapter_name"] = adapter.name


def cut_insert_adapters(pairs: DataFrame, adapter1: Adapter, adapter2: Adapter, *, action: str | None = "trim", correct: str | None = None, symmetric: bool = True, **how) -> DataFrame:
    """Remove adapters where the mates' overlap shows the insert's end; else by aligning each adapter.

    A match on one mate only is copied to the other (symmetric). correct: N, conservative or liberal settles mismatches
    of the overlap.
    """
    least = how.get("min_insert_overlap", 1)

    def work(one, two, both):
        both = [x for x in both if min(len(one[x]["sequence"]), len(two[x]["sequence"])) >= least]
        if not both:
            return
        r1, n1 = kernels.encode([one[x]["sequence"] for x in both])
        r2, n2 = kernels.encode([two[x]["sequence"] for x in both])
        got = kernels.insert_matches(r1, n1, r2, n2, adapter1.sequence, adapter2.sequence, **how)
        miss = [k for k in range(len(both)) if got[k, 0] < 0]
        alone = [dict(zip(miss, match_batch(a, [reads[both[k]]["sequence"] for k in miss]))) for a, reads in ((adapter1, one), (adapter2, two))]
        for k, x in enumerate(both):
            a, b = one[x], two[x]
            size, wrong, cut, l1, l2, errors = (int(v) for v in got[k])
            m: list[tuple | None] = [None, None]
            overlap = None
            a["insert_overlap"] = b["insert_overlap"] = size >= 0
            common = min(len(a["sequence"]), len(b["sequence"]))
            if size >= 0:
                if cut:
                    for i, (n, read) in enumerate(((l1, a), (l2, b))):
                        e = min(n, errors)
                        if n > 0 and n - e > 0:
                            m[i] = (0, n, size, len(read["sequence"]), n - e, e)
                if wrong:
                    overlap = size
            else:
                m = [alone[0][k], alone[1][k]]
                if correct and m[0] and m[1] and m[0][2] == m[1][2]:
                    overlap = m[0][2]
            if symmetric and (m[0] is None) != (m[1] is None):
                i = 0 if m[0] is None else 1
                src, read = m[1 - i], (a, b)[i]
                n = len(read["sequence"])
                if src[2] <= n:
                    m[i] = src if src[3] >= n else (src[0], src[1] - (n - src[3]), src[2], n, src[4], src[5])
                    if correct and size < 0 and overlap is None:
                        overlap = src[2]
            if correct and overlap:
                # r1[0:overlap] lies on the end of rc(r2) cut to the common length.
                s2 = b["sequence"][:common] if size >= 0 else b["sequence"]
                q2 = b["qualities"]
                q2_part = None if q2 is None else q2[: len(s2)]
                n = min(overlap, len(a["sequence"]), len(s2))
                s1, q1, t2, u2, c1, c2 = kernels.correct(a["sequence"], a["qualities"], s2, q2_part, 0, n, len(s2) - overlap, correct)
                a["sequence"], a["qualities"], a["corrected"] = s1, q1, a["corrected"] + c1
                b["sequence"], b["corrected"] = t2 + b["sequence"][len(s2) :], b["corrected"] + c2
                b["qualities"] = None if q2 is None else u2 + q2[len(s2) :]
            for read, g, adapter in ((a, m[0], adapter1), (b, m[1], adapter2)):
                if g is not None:
                    s, q = read["sequence"], read["qualities"]
                    _record(read, adapter, g[1], g[2], g[3], g[4], g[5])
                    if action is not None and g[2] < len(s):
                        read["sequence"] = s[: g[2]] + ("N" * (len(s) - g[2]) if action == "mask" else "")
                        if action == "trim" and q is not None:
                            read["qualities"] = q[: g[2]]

    return _over_pairs(pairs, work)


def merge_overlapping(pairs: DataFrame, min_overlap: float = 0.9, error_rate: float = 0.2, correct: str | None = None) -> DataFrame:
    """Mates that overlap become one read in r1 (merged), r2 null. min_overlap: a share of the shorter read up to 1, else bases."""

    def work(one, two, both):
        groups: dict[bool, list[int]] = {}
        for x in both:
            a, b = one[x], two[x]
            short = min(len(a["sequence"]), len(b["sequence"]))
            need = max(2, round(min_overlap * short)) if min_overlap <= 1 else int(min_overlap)
            if short >= need:
                groups.setdefault(bool(a["insert_overlap"] and b["insert_overlap"]), []).append(x)
        for matched, xs in groups.items():
            raw, n2 = kernels.encode([two[x]["sequence"] for x in xs])
            rcs = kernels.reverse_complement(raw, n2)
            flags = kernels.START_ADAPTER | kernels.STOP_READ if matched else 15
            reads, lengths = kernels.encode([one[x]["sequence"] for x in xs])
            # Mates that are equal over their whole length align without the matrix: no other cell has as many matches.
            got = np.zeros((len(xs), 6), np.int64)
            got[:, 1] = got[:, 3] = got[:, 4] = n2
            width = min(rcs.shape[1], reads.shape[1])
            todo = np.flatnonzero((n2 != lengths) | (rcs[:, :width] != reads[:, :width]).any(axis=1))
            if len(todo):
                got[todo] = kernels.locate(rcs[todo], reads[todo], lengths[todo], flags, error_rate, 1, adapter_lengths=n2[todo])
            for k, (x, g) in enumerate(zip(xs, got)):
                rc2 = rcs[k, : n2[k]].tobytes().decode("latin-1")
                a, b = one[x], two[x]
                s, t = a["sequence"], int(n2[k])
                short = min(len(s), t)
                need = max(2, round(min_overlap * short)) if min_overlap <= 1 else int(min_overlap)
                r2_start, r2_stop, r1_start, r1_stop, same, errors = (int(v) for v in g)
                if r2_start < 0 or same < need:
                    continue
                rc, q1, q2 = rc2, a["qualities"], b["qualities"]
                if correct and errors > 0 and not matched and r1_stop - r1_start == r2_stop - r2_start:
                    s, q1, fixed, q2, c1, c2 = kernels.correct(s, q1, b["sequence"], q2, r1_start, r1_stop, r2_start, correct)
                    raw2, m2 = kernels.encode([fixed])
                    rc = kernels.reverse_complement(raw2, m2)[0].tobytes().decode("latin-1")
                    a["corrected"] += c1
                    b["corrected"] += c2
                rq = None if q2 is None else q2[::-1]
                if r2_start == 0 and r2_stop == t:
                    a["sequence"], a["qualities"] = s, q1
                elif r1_start == 0 and r1_stop == len(s):
                    a["sequence"], a["qualities"] = rc, rq
                elif r1_start > 0:
                    a["sequence"], a["qualities"] = s + rc[r2_stop:], None if q1 is None or rq is None else q1 + rq[r2_stop:]
                else:
                    a["sequence"], a["qualities"] = rc + s[r1_stop:], None if q1 is None or rq is None else rq + q1[r1_stop:]
                a["merged"] = True
                two[x] = None

    return _over_pairs(pairs, work)


def overwrite_low_quality(pairs: DataFrame, low: int, high: int, window: int, base: int = 33) -> DataFrame:
    """A read whose first bases are poor on average takes the reverse complement of a mate whose first bases are good."""
    mean = lambda r: F.aggregate(dna.quality_values(F.substring(F.col(f"{r}.qualities"), 1, window), base), F.lit(0), lambda a, x: a + x) / F.lit(window)
    enough = (F.length("r1.sequence") >= window) & (F.length("r2.sequence") >= window)
    bad1, bad2 = enough & (mean("r1") < low) & (mean("r2") >= high), enough & (mean("r2") < low) & (mean("r1") >= high)

    def donor(r):
        c = F.col(r)
        return c.withField("sequence", dna.reverse_complement(c["sequence"])).withField("qualities", F.reverse(c["qualities"])).withField("corrected", F.lit(1))

    out = pairs.withColumns({"_1": bad1, "_2": bad2})
    return out.withColumns({"r1": F.when(F.col("_1"), donor("r2")).otherwise(F.col("r1")), "r2": F.when(F.col("_2"), donor("r1")).otherwise(F.col("r2"))}).drop("_1", "_2")
