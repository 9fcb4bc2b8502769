"""The trim command as a plan: options, resolved once, become a chain of projections, one routing column and metrics."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.operators import adapters as ad
from helixframe.operators import filters as fi
from helixframe.operators import modifiers as mo
from helixframe.operators import pairs as pa
from helixframe.operators import qc
from helixframe.plans import values

#: Presets of the bisulfite option that cut without looking at the sequence.
MIRNA = {"adapters": (("back", "TGGAATTCTCGG"),), "quality_cutoff": (20, 20), "minimum_length": 16, "error_rate": 0.12}


@dataclass
class TrimOptions:
    adapters: Sequence[tuple[str, str]] = ()  # (kind, specification) for read 1
    adapters2: Sequence[tuple[str, str]] = ()
    aligner: str = "adapter"  # or insert
    error_rate: float | None = None
    overlap: int | None = None
    indels: bool = True
    indel_cost: int | None = None
    times: int = 1
    action: str | None = "trim"  # trim, mask or None
    read_wildcards: bool = False
    adapter_wildcards: bool = True
    adapter_max_rmp: float | None = None
    insert_max_rmp: float = 1e-6
    insert_match_error_rate: float = 0.2
    insert_match_adapter_error_rate: float = 0.2
    op_order: str = "CGQAW"
    cut: Sequence[int] = ()
    cut2: Sequence[int] = ()
    min_cut: Sequence[int] = ()
    min_cut2: Sequence[int] = ()
    quality_cutoff: Sequence[int] = ()
    quality_base: int = 33
    nextseq_trim: int | None = None
    trim_n: bool = False
    overwrite: tuple[int, int, int] | None = None  # low, high, window
    bisulfite: str | None = None
    merge: bool = False
    merge_min_overlap: float = 0.9
    merge_error_rate: float = 0.2
    correct: str | None = None
    length_tag: str | None = None
    strip_suffix: Sequence[str] = ()
    prefix: str = ""
    suffix: str = ""
    zero_cap: bool = False
    double_encode: bool = False
    trim_primer: bool = False
    minimum_length: int | None = None
    maximum_length: int | None = None
    max_n: float | None = None
    discard_trimmed: bool = False
    discard_untrimmed: bool = False
    pair_filter: str = "any"
    legacy: bool = False
    mirna: bool = False

    def resolved(self) -> TrimOptions:
        """With all defaults that depend on other options; an error for options that exclude each other."""
        o = TrimOptions(**{f.name: getattr(self, f.name) for f in fields(self)})
        if o.mirna:
            o.adapters = o.adapters or MIRNA["adapters"]
            o.quality_cutoff = o.quality_cutoff or MIRNA["quality_cutoff"]
            o.minimum_length = o.minimum_length or MIRNA["minimum_length"]
            o.error_rate = MIRNA["error_rate"] if o.error_rate is None else o.error_rate
        if o.aligner == "insert":
            if not (len(o.adapters) == len(o.adapters2) == 1 and o.adapters[0][0] == o.adapters2[0][0] == "back"):
                raise ValueError("the insert aligner needs one 3' adapter for each read")
            o.overlap = 1 if o.overlap is None else o.overlap
            o.adapter_max_rmp = 1e-6 if o.adapter_max_rmp is None else o.adapter_max_rmp
            o.indel_cost = 3 if o.indel_cost is None else o.indel_cost
        o.overlap = o.overlap if o.overlap is not None else 1 if o.adapter_max_rmp is not None else 3
        o.error_rate = 0.1 if o.error_rate is None else o.error_rate
        o.indel_cost = 1 if o.indel_cost is None else o.indel_cost
        if len(o.quality_cutoff) == 1:
            o.quality_cutoff = (0, o.quality_cutoff[0])
        if o.discard_trimmed and o.discard_untrimmed:
            raise ValueError("nothing is left if trimmed and untrimmed reads are discarded")
        if not 0 <= o.error_rate <= 1:
            raise ValueError("an error rate lies between 0 and 1")
        if set(o.op_order) - set("ACGQW"):
            raise ValueError("op_order holds A, C, G, Q and W")
        if o.pair_filter not in ("any", "both"):
            raise ValueError("pair_filter is any or both")
        if len(o.cut) > 2 or len(o.cut2) > 2 or len(o.cut) == 2 and o.cut[0] * o.cut[1] > 0:
            raise ValueError("one cut for each end")
        return o

    @classmethod
    def from_tokens(cls, text: str) -> TrimOptions:
        """From a configuration of key=value tokens; values are JSON or plain text."""
        got = {}
        for token in re.findall(r"\S+", text):
            key, _, value = token.partition("=")
            key = key.lstrip("-").replace("-", "_")
            try:
                got[key] = json.loads(value) if value else True
            except ValueError:
                got[key] = value
        return cls(**got)


@dataclass
class TrimPlan:
    options: TrimOptions
    adapters1: list[ad.Adapter] = field(default_factory=list)
    adapters2: list[ad.Adapter] = field(default_factory=list)

    @classmethod
    def of(cls, options: TrimOptions) -> TrimPlan:
        o = options.resolved()
        how = dict(max_error_rate=o.error_rate, min_overlap=o.overlap, indels=o.indels, indel_cost=o.indel_cost, read_wildcards=o.read_wildcards, adapter_wildcards=o.adapter_wildcards, max_rmp=o.adapter_max_rmp)
        return cls(o, ad.parse_all(o.adapters, **how), ad.parse_all(o.adapters2, **how))

    def _own(self, letter: str, mate: int) -> list[mo.Modifier]:
        """Modifiers of one read for a letter of op_order."""
        o = self.options
        if letter == "C" and (cut := (o.cut, o.cut2)[mate - 1]):
            return [mo.cutter(cut)]
        if letter == "G" and o.nextseq_trim is not None:
            return [mo.nextseq_trimmer(o.nextseq_trim, o.quality_base)]
        if letter == "Q" and o.quality_cutoff:
            return [mo.quality_trimmer(*o.quality_cutoff, o.quality_base)]
        if letter == "A" and (found := (self.adapters1, self.adapters2)[mate - 1]):
            return [lambda r: ad.cut_adapters(r, found, o.times, o.action)]
        return []

    def _after(self, mate: int) -> list[mo.Modifier]:
        """Modifiers that follow the ordered ones."""
        o, out = self.options, []
        if o.bisulfite == "rrbs":
            out.append(mo.rrbs_trimmer())
        elif o.bisulfite in ("non-directional", "non-directional-rrbs"):
            out.append(mo.non_directional_bisulfite_trimmer(rrbs=o.bisulfite.endswith("rrbs")))
        elif o.bisulfite in ("truseq", "epignome"):
            out.append(mo.truseq_bisulfite_trimmer())
        elif o.bisulfite == "swift":
            out.append(mo.swift_bisulfite_trimmer(mate))
        elif o.bisulfite:
            raise ValueError(f"no such bisulfite protocol: {o.bisulfite}")
        if o.trim_n:
            out.append(mo.n_end_trimmer())
        if cut := (o.min_cut, o.min_cut2)[mate - 1]:
            out.append(mo.min_cutter(cut))
        if o.length_tag:
            out.append(mo.length_tagger(o.length_tag))
        if o.strip_suffix:
            out.append(mo.suffix_remover(o.strip_suffix))
        if o.prefix or o.suffix:
            out.append(mo.prefix_suffix_adder(o.prefix, o.suffix))
        if o.double_encode:
            out.append(mo.double_encoder())
        if o.zero_cap:
            out.append(mo.zero_capper(o.quality_base))
        if o.trim_primer:
            out.append(mo.primer_trimmer())
        return out

    def modifiers(self) -> list[mo.Modifier]:
        return [m for letter in self.options.op_order for m in self._own(letter, 1)] + self._after(1)

    def run(self, reads: DataFrame) -> DataFrame:
        """Single reads with all modifiers applied and dest."""
        out = mo.chain(mo.prepared(reads), self.modifiers())
        return fi.route(out, self._rules(lambda p: fi.single(p)))

    def run_pairs(self, pairs: DataFrame) -> DataFrame:
        """Pairs (read_idx, r1, r2) with all modifiers applied and dest."""
        o = self.options
        for letter in o.op_order:
            if letter == "A" and o.aligner == "insert":
                pairs = pa.cut_insert_adapters(
                    pairs, self.adapters1[0], self.adapters2[0], action=o.action, correct=o.correct, min_insert_overlap=o.overlap, insert_max_rmp=o.insert_max_rmp,
                    max_insert_mismatch=o.insert_match_error_rate, max_adapter_mismatch=o.insert_match_adapter_error_rate, wildcard_adapter=o.adapter_wildcards, wildcard_read=o.read_wildcards,
                )
            elif letter == "W":
                if o.overwrite:
                    pairs = pa.overwrite_low_quality(pairs, *o.overwrite, o.quality_base)
            else:
                pairs = mo.chain_pairs(pairs, self._own(letter, 1), [] if o.legacy else self._own(letter, 2))
        pairs = mo.chain_pairs(pairs, self._after(1), [] if o.legacy else self._after(2))
        if o.merge:
            pairs = pa.merge_overlapping(pairs, o.merge_min_overlap, o.merge_error_rate, o.correct)
        affected = 0 if o.legacy else 2 if o.pair_filter == "both" else 1
        return fi.route(pairs, self._rules(lambda p: fi.paired(p, affected), o.merge))

    def _rules(self, test, merged: bool = False):
        o = self.options
        return fi.standard_rules(test, merged_out=merged, minimum=o.minimum_length, maximum=o.maximum_length, max_n=o.max_n, discard_trimmed=o.discard_trimmed, discard_untrimmed=o.discard_untrimmed)


def summary(routed: DataFrame) -> DataFrame:
    """Per dest: records, bases, records with adapters, bases cut by trims and from adapters on, mean length, and fractions of
    all records. Bases from adapters on are those of the recorded matches, whatever the action did with them."""
    removed = F.aggregate("matches", F.lit(0), lambda a, m: a + F.when(m["front"], m["rstop"]).otherwise(m["length"] - m["rstart"]))
    by = routed.groupBy("dest").agg(
        F.count(F.lit(1)).alias("records"),
        F.sum(F.length("sequence")).alias("bp"),
        F.sum(F.col("adapter_name").isNotNull().cast("long")).alias("records_with_adapters"),
        F.sum(F.aggregate("clipped", F.lit(0), lambda a, x: a + x)).alias("bp_clipped"),
        F.sum(removed).alias("bp_adapters"),
        F.avg(F.length("sequence")).alias("mean_length"),
    )
    total = by.agg(F.sum("records").alias("total_records"), F.sum("bp").alias("total_bp"))
    # One row: the scalar totals.
    return by.join(F.broadcast(total), F.lit(True)).withColumn("fraction_records", F.col("records") / F.col("total_records"))


def pair_summary(routed: DataFrame) -> DataFrame:
    """Per dest: pairs, those with a corrected base, and for each mate bases, reads with adapters and corrected bases, with
    shares of all. A missing mate has no bases."""
    fixed = F.coalesce(F.col("r1.corrected"), F.lit(0)) + F.coalesce(F.col("r2.corrected"), F.lit(0))
    sums = [F.count(F.lit(1)).alias("n_pairs"), F.sum((fixed > 0).cast("long")).alias("n_corrected")]
    for k in ("1", "2"):
        sums.append(F.sum(F.coalesce(F.length(f"r{k}.sequence"), F.lit(0))).alias(f"read{k}_bp"))
        sums.append(F.sum(F.col(f"r{k}.adapter_name").isNotNull().cast("long")).alias(f"read{k}_with_adapters"))
        sums.append(F.sum(F.coalesce(F.col(f"r{k}.corrected"), F.lit(0))).alias(f"read{k}_corrected"))
    by = routed.groupBy("dest").agg(*sums)
    parts = ("n_pairs", "read1_bp", "read2_bp")
    total = by.agg(*[F.sum(c).alias(f"total_{c}") for c in parts])
    # One row: the totals.
    out = by.join(F.broadcast(total), F.lit(True))
    return out.withColumns({f"fraction_{c}": F.when(F.col(f"total_{c}") > 0, F.col(c) / F.col(f"total_{c}")) for c in parts})


def statistics(reads: DataFrame) -> dict[str, DataFrame]:
    """All statistics of a frame of single reads, before or after trimming."""
    return {
        "lengths": qc.length_histogram(reads),
        "gc": qc.gc_histogram(reads),
        "qualities": qc.quality_histogram(reads),
        "bases": qc.position_bases(reads),
        "base_qualities": qc.position_qualities(reads),
    }


def report(routed: DataFrame, as_json: bool = True, kind: str | None = None) -> str:
    """The summary as json, yaml or text (kind; by default json, or text if not as_json)."""
    rows = [r.asDict() for r in summary(routed).orderBy("dest").collect()]
    kind = kind or ("json" if as_json else "text")
    if kind == "json":
        return json.dumps({"dest": rows}, indent=1)
    if kind == "yaml":
        return values.as_yaml({"dest": rows})
    return "\n".join(f"{r['dest']}: {r['records']} reads ({100 * r['fraction_records']:.1f}%), {r['bp']} bp, {r['records_with_adapters']} with adapters" for r in rows)
