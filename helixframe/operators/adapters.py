"""Adapters: the grammar of their specification, matching and removal.

Matching is split: an exact hit is a Catalyst expression; only reads without one reach the alignment kernel, in Arrow
batches. Adapter sets are small parameters; they travel in the plan.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.functions import dna
from helixframe.functions.probability import random_match
from helixframe.operators import kernels
from helixframe.operators.modifiers import MATCH, prepared


@dataclass(frozen=True)
class Adapter:
    name: str
    sequence: str
    where: str = "back"  # back, front, prefix, suffix, anywhere, linked
    max_error_rate: float = 0.1
    min_overlap: int = 3
    indels: bool = True
    indel_cost: int = 1
    read_wildcards: bool = False
    adapter_wildcards: bool = True
    max_rmp: float | None = None
    back: Adapter | None = None  # the second part of a linked adapter

    @property
    def wild(self) -> bool:
        return self.adapter_wildcards and not set(self.sequence.upper()) <= set("ACGT")

    @property
    def overlap(self) -> int:
        return min(self.min_overlap, len(self.sequence))


#: How often braces repeat a character at most.
MOST_REPEATS = 10_000


def expand_braces(spec: str) -> str:
    """X{n} becomes n times X."""
    if re.sub(r"[^{}]", "", spec).replace("{}", "") or re.search(r"(^|[{}])\{|\{(?!\d+\})", spec):
        raise ValueError(f"braces don't fit in {spec}")
    if any(int(n) > MOST_REPEATS for n in re.findall(r"\{(\d+)\}", spec)):
        raise ValueError(f"a character is repeated more than {MOST_REPEATS} times in {spec}")
    return re.sub(r"(.)\{(\d+)\}", lambda m: m[1] * int(m[2]), spec)


def parse(spec: str, kind: str = "back", name: str | None = None, **how) -> Adapter:
    """One adapter from name=SEQ, ^SEQ, SEQ$, A...B, ...B, A..., X{n}; kind: back, front or anywhere."""
    head, sep, tail = spec.partition("=")
    if sep:
        name, spec = head.strip() or None, tail.strip()
    spec = expand_braces(spec.strip())
    if "..." in spec:
        one, _, two = spec.partition("...")
        if one and two:
            front = replace(parse(one if one.startswith("^") else f"^{one}", "front", name, **how), where="prefix")
            last = parse(two, "back", name, **how)
            return replace(front, name=name or f"{front.sequence}...{last.sequence}", where="linked", back=last)
        if kind == "anywhere":
            raise ValueError("no part of a linked adapter can lie anywhere")
        if not one and kind == "front":
            raise ValueError("a 5' adapter can't follow dots")
        if one:  # A... : a 5' adapter, anchored for back
            return parse(one if one.startswith("^") or kind == "front" else f"^{one}", "front", name, **how)
        return parse(two, "back", name, **how)
    where = kind
    if spec.startswith("^"):
        if kind == "back":
            raise ValueError("a 3' adapter can't be anchored at the front")
        where, spec = "prefix" if kind == "front" else kind, spec[1:]
        if kind == "anywhere":
            raise ValueError("an adapter that can lie anywhere has no anchor")
    elif spec.endswith("$"):
        if kind != "back":
            raise ValueError("only a 3' adapter can be anchored at the back")
        where, spec = "suffix", spec[:-1]
    sequence = spec.upper().replace("U", "T")
    if not sequence:
        raise ValueError("an adapter without a sequence")
    bad = set(sequence) - set(kernels.CODES)
    if bad:
        raise ValueError(f"adapter {sequence} has characters that are no IUPAC code: {''.join(sorted(bad))}")
    return Adapter(name or sequence, sequence, where, **how)


def read_adapters(path: str) -> list[tuple[str, str]]:
    """(name, sequence) of a FASTA file: adapter sets are small parameters, read on the driver."""
    from helixframe.sources.records import _open, fasta_records

    with _open(path) as f:
        return [((r[0].split() or [""])[0], r[2]) for r in fasta_records(f, path)]


class KnownAdapters:
    """Named sequences, one name or several for each, with reverse complements if asked; kept as a FASTA file."""

    def __init__(self, named: Sequence[tuple[str, str]] = (), reverse: bool = False):
        self.names: dict[str, list[str]] = {}
        for name, seq in named:
            self.add(name, seq, reverse)

    def add(self, name: str, seq: str, reverse: bool = False) -> None:
        if name not in self.names.setdefault(seq, []):
            self.names[seq].append(name)
        if reverse:
            self.add(f"{name}_rc", seq.translate(str.maketrans(dna.IUPAC, dna.COMPLEMENT))[::-1])

    def sequence(self, name: str) -> str | None:
        return next((s for s, names in self.names.items() if name in names), None)

    def items(self) -> list[tuple[str, str]]:
        return [(n, s) for s, names in self.names.items() for n in names]

    def save(self, path: str) -> None:
        with open(path, "w") as f:
            f.writelines(f">{n}\n{s}\n" for n, s in self.items())

    @classmethod
    def load(cls, path: str, reverse: bool = False) -> KnownAdapters:
        return cls(read_adapters(path), reverse)


def parse_all(specs: Sequence[tuple[str, str]], **how) -> list[Adapter]:
    """Adapters from (kind, spec); names that none gives are numbers. file:PATH stands for all records of a FASTA file, whose
    names end at the first white space."""
    specs = [x for kind, spec in specs for x in ([(kind, f"{n}={s}") for n, s in read_adapters(spec[5:])] if spec.startswith("file:") else [(kind, spec)])]
    out = []
    for i, (kind, spec) in enumerate(specs, 1):
        a = parse(spec, kind, None, **how)
        out.append(a if "=" in spec else replace(a, name=str(i)))
    return out


def exact_start(adapter: Adapter, seq: Column) -> Column:
    """0-based start of an exact hit, or null. Leftmost unless anchored."""
    up, a = F.upper(seq), F.lit(adapter.sequence)
    at = F.locate(adapter.sequence, up) - 1
    if adapter.where == "prefix":
        return F.when(up.startswith(a), F.lit(0))
    if adapter.where == "suffix":
        return F.when(up.endswith(a), F.length(seq) - len(adapter.sequence))
    return F.when(at >= 0, at)


def match_batch(adapter: Adapter, seqs: list[str]) -> list[tuple | None]:
    """(astart, astop, rstart, rstop, matches, errors) or None for each read."""
    seqs = [s.upper() for s in seqs]
    out: list[tuple | None] = [None] * len(seqs)
    m, todo = len(adapter.sequence), list(range(len(seqs)))
    if not adapter.wild:
        todo = []
        for x, s in enumerate(seqs):
            at = -1
            if adapter.where == "prefix":
                at = 0 if s.startswith(adapter.sequence) else -1
            elif adapter.where == "suffix":
                at = len(s) - m if s.endswith(adapter.sequence) else -1
            else:
                at = s.find(adapter.sequence)
            if at >= 0:
                out[x] = (0, m, at, at + m, m, 0)
            else:
                todo.append(x)
    if not todo:
        return out
    anchored = adapter.where in ("prefix", "suffix")
    if anchored and not adapter.indels:
        ref = np.frombuffer(adapter.sequence.encode(), np.uint8)
        for x in todo:
            s = np.frombuffer(seqs[x].encode("latin-1", "replace"), np.uint8)
            n = min(m, len(s))
            part, want = (s[:n], ref[:n]) if adapter.where == "prefix" else (s[len(s) - n :], ref[m - n :])
            same = int(np.diagonal(kernels.equal(want, part, adapter.wild, adapter.read_wildcards)).sum()) if n else 0
            out[x] = (0, n, 0, n, same, n - same) if adapter.where == "prefix" else (m - n, m, len(s) - n, len(s), same, n - same)
    else:
        order = sorted(todo, key=lambda x: len(seqs[x]))
        for at in range(0, len(order), 4096):  # reads of like length share a batch: little padding
            part = order[at : at + 4096]
            reads, lengths = kernels.encode([seqs[x] for x in part])
            got = kernels.locate(adapter.sequence, reads, lengths, kernels.KINDS[adapter.where], adapter.max_error_rate, adapter.overlap, adapter.indel_cost if adapter.indels else 100_000, adapter.wild, adapter.read_wildcards)
            for x, row in zip(part, got):
                if row[0] >= 0:
                    out[x] = tuple(int(v) for v in row)
    for x in todo:
        if (g := out[x]) is not None:
            size = g[1] - g[0]
            if size <= 0 or g[4] <= 0 or size < adapter.overlap or g[5] / size > adapter.max_error_rate or adapter.max_rmp is not None and random_match(g[4], size) > adapter.max_rmp:
                out[x] = None
    return out


def _is_front(adapter: Adapter, g: tuple) -> bool:
    return adapter.where in ("front", "prefix") or adapter.where == "anywhere" and g[2] == 0


def _rounds(adapters: Sequence[Adapter], seqs: list[str], quals: list[str | None], times: int, action: str | None) -> list[tuple]:
    """(sequence, qualities, adapter name, matches, bases cut at front, at back) of each read."""
    count = len(seqs)
    now, nowq = list(seqs), list(quals)
    found: list[list[dict]] = [[] for _ in range(count)]
    cut = [[0, 0] for _ in range(count)]
    live = [x for x in range(count) if seqs[x]]
    for _ in range(times):
        if not live:
            break
        best: dict[int, tuple] = {}
        for ord_, a in enumerate(adapters):
            first = match_batch(replace(a, where="prefix") if a.where == "linked" else a, [now[x] for x in live])
            for x, g in zip(live, first):
                if g is not None and (x not in best or g[4] > best[x][0][4]):
                    best[x] = (g, ord_)
        for x, (g, ord_) in best.items():
            a, s, q = adapters[ord_], now[x], nowq[x]
            front = a.where == "linked" or _is_front(a, g)
            found[x].append({"adapter": a.name, "front": front, "astart": g[0], "astop": g[1], "rstart": g[2], "rstop": g[3], "matches": g[4], "errors": g[5], "length": len(s), "adjacent": "" if front or g[2] == 0 or s[g[2] - 1] not in "ACGT" else s[g[2] - 1], "sequence": s, "qualities": q})
            if front:
                now[x], nowq[x] = s[g[3] :], None if q is None else q[g[3] :]
                cut[x][0] += g[3]
            else:
                now[x], nowq[x] = s[: g[2]], None if q is None else q[: g[2]]
                cut[x][1] += len(s) - g[2]
        # The second part of linked adapters: all reads of an adapter at once.
        for a in {adapters[o] for _, o in best.values() if adapters[o].where == "linked"}:
            xs = [x for x, (_, o) in best.items() if adapters[o] is a and now[x]]
            for x, b in zip(xs, match_batch(a.back, [now[x] for x in xs])):
                if b is not None:
                    s, q = now[x], nowq[x]
                    found[x].append({"adapter": a.name, "front": False, "astart": b[0], "astop": b[1], "rstart": b[2], "rstop": b[3], "matches": b[4], "errors": b[5], "length": len(s), "adjacent": "" if b[2] == 0 or s[b[2] - 1] not in "ACGT" else s[b[2] - 1], "sequence": s, "qualities": q})
                    now[x], nowq[x] = s[: b[2]], None if q is None else q[: b[2]]
                    cut[x][1] += len(s) - b[2]
        live = [x for x in best if now[x]]
    out = []
    for x in range(count):
        name = found[x][-1]["adapter"] if found[x] else None
        if action == "trim" or not found[x]:
            out.append((now[x], nowq[x], name, found[x], *(cut[x] if action == "trim" else (0, 0))))
        elif action == "mask":
            out.append(("N" * cut[x][0] + now[x] + "N" * cut[x][1], quals[x], name, found[x], 0, 0))
        else:
            out.append((seqs[x], quals[x], name, found[x], 0, 0))
    return out


def cut_adapters(reads: DataFrame, adapters: Sequence[Adapter], times: int = 1, action: str | None = "trim") -> DataFrame:
    """Remove the best adapter up to times times. action: trim, mask (N in its place) or None (only recorded).

    Adds to the columns of prepared(): adapter_name (of the last match) and matches. Empty reads pass unchanged.
    """
    reads = prepared(reads)
    fields = [f for f in reads.schema.fields]
    names = [f.name for f in fields]

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if not len(pdf):
                continue
            quals = [None if q is None or q != q else q for q in pdf["qualities"]]
            got = _rounds(adapters, [s or "" for s in pdf["sequence"]], quals, times, action)
            pdf = pdf.copy()
            pdf["sequence"], pdf["qualities"] = [g[0] for g in got], [g[1] for g in got]
            old = list(pdf["adapter_name"])
            pdf["adapter_name"] = [g[2] if g[2] is not None else o for g, o in zip(got, old)]
            pdf["matches"] = [[*m, *g[3]] for m, g in zip(pdf["matches"], got)]
            yield pdf[names]

    return reads.mapInPandas(rows, T.StructType(fields))


def cut_exact(reads: DataFrame, adapter: Adapter) -> DataFrame:
    """As cut_adapters for one adapter, once, without errors: all of it Catalyst expressions."""
    reads = prepared(reads).withColumn("_at", exact_start(adapter, F.col("sequence")))
    seq, qual, m = F.col("sequence"), F.col("qualities"), len(adapter.sequence)
    front = F.lit(adapter.where in ("front", "prefix")) if adapter.where != "anywhere" else F.col("_at") == 0
    cut = lambda text: F.when(F.col("_at").isNull(), text).when(front, F.substring(text, F.col("_at") + m + 1, F.length(seq))).otherwise(F.substring(text, F.lit(1), F.col("_at")))
    before = F.substring(seq, F.col("_at"), F.lit(1))
    match = F.struct(
        F.lit(adapter.name).alias("adapter"), front.alias("front"), F.lit(0).alias("astart"), F.lit(m).alias("astop"), F.col("_at").alias("rstart"), (F.col("_at") + m).alias("rstop"), F.lit(m).alias("matches"), F.lit(0).alias("errors"),
        F.length(seq).alias("length"), F.when(front | (F.col("_at") == 0) | ~before.rlike("[ACGT]"), "").otherwise(before).alias("adjacent"), seq.alias("sequence"), qual.alias("qualities"),
    )
    out = reads.withColumns(
        {
            "sequence": cut(seq),
            "qualities": cut(qual),
            "adapter_name": F.coalesce(F.when(F.col("_at").isNotNull(), F.lit(adapter.name)), F.col("adapter_name")),
            "matches": F.when(F.col("_at").isNotNull(), F.concat("matches", F.array(match.cast(MATCH)))).otherwise(F.col("matches")),
        }
    )
    return out.drop("_at")


def best_exact(adapters: Sequence[Adapter], seq: Column) -> Column:
    """Name of the exact adapter with most matches, the first of equals; null without a hit."""
    hits = F.array(*[F.when(exact_start(a, seq).isNotNull(), F.struct(F.lit(-len(a.sequence)).alias("m"), F.lit(i).alias("o"), F.lit(a.name).alias("name"))) for i, a in enumerate(adapters)])
    return F.get(F.array_sort(F.filter(hits, lambda h: h.isNotNull())), F.lit(0))["name"]


def length_error_histogram(reads: DataFrame) -> DataFrame:
    """adapter, end, length, errors, n: bases removed and errors of all recorded matches."""
    m = reads.select(F.explode("matches").alias("m"))
    length = F.when(F.col("m.front"), F.col("m.rstop")).otherwise(F.col("m.length") - F.col("m.rstart"))
    return m.groupBy(F.col("m.adapter").alias("adapter"), F.when(F.col("m.front"), "front").otherwise("back").alias("end"), length.alias("length"), F.col("m.errors").alias("errors")).agg(F.count(F.lit(1)).alias("n"))


def adjacent_bases(reads: DataFrame) -> DataFrame:
    """adapter, base, n, share, warn: bases before 3' adapters; a warning where one base has over 0.8 of 20 or more."""
    m = reads.select(F.explode("matches").alias("m")).where(~F.col("m.front"))
    by = m.groupBy(F.col("m.adapter").alias("adapter"), F.col("m.adjacent").alias("base")).agg(F.count(F.lit(1)).alias("n"))
    total = by.groupBy("adapter").agg(F.sum("n").alias("total"))
    share = F.col("n") / F.col("total")
    return by.join(total, "adapter").select("adapter", "base", "n", share.alias("share"), ((share > 0.8) & (F.col("total") >= 20) & (F.col("base") != "")).alias("warn"))


def rest(reads: DataFrame) -> DataFrame:
    """read_idx, name, rest: what the last match left over outside the kept part; none if empty."""
    m = F.try_element_at(F.col("matches"), F.lit(-1))
    text = F.when(m["front"], F.substring(m["sequence"], F.lit(1), m["rstart"])).otherwise(F.substring(m["sequence"], m["rstop"] + 1, m["length"]))
    return reads.where(F.size("matches") > 0).select("read_idx", "name", text.alias("rest")).where("rest <> ''")


def wildcards(reads: DataFrame, adapters: Sequence[Adapter]) -> DataFrame:
    """read_idx, name, bases: what stands against the adapter's N in the last match."""
    known = F.create_map(*[F.lit(x) for a in adapters for x in (a.name, a.sequence)])
    m = F.try_element_at(F.col("matches"), F.lit(-1))
    a = F.try_element_at(known, m["adapter"])
    size = F.least(m["astop"] - m["astart"], m["rstop"] - m["rstart"])
    at = F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)))
    hit = F.filter(at, lambda i: F.substring(a, m["astart"] + i + 1, F.lit(1)) == "N")
    bases = F.array_join(F.transform(hit, lambda i: F.substring(m["sequence"], m["rstart"] + i + 1, F.lit(1))), "")
    return reads.where(F.size("matches") > 0).select("read_idx", "name", bases.alias("bases"))


def info(reads: DataFrame) -> DataFrame:
    """read_idx, fields: 11 columns for each match, or name, -1, sequence, qualities for a read without."""
    m = F.col("m")
    q = lambda a, b: F.coalesce(dna.slice_(m["qualities"], a, b), F.lit(""))
    zero, n = F.lit(0), m["length"]
    hit = F.array(
        F.col("name"), m["errors"].cast("string"), m["rstart"].cast("string"), m["rstop"].cast("string"),
        dna.slice_(m["sequence"], zero, m["rstart"]), dna.slice_(m["sequence"], m["rstart"], m["rstop"]), dna.slice_(m["sequence"], m["rstop"], n), m["adapter"],
        q(zero, m["rstart"]), q(m["rstart"], m["rstop"]), q(m["rstop"], n),
    )
    none = F.array(F.col("name"), F.lit("-1"), F.col("sequence"), F.coalesce("qualities", F.lit("")))
    return reads.select("*", F.posexplode_outer("matches").alias("turn", "m")).select("read_idx", F.coalesce("turn", F.lit(0)).alias("turn"), F.when(m.isNull(), none).otherwise(hit).alias("fields"))
