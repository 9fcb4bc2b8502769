"""Adapters in colour space: reads are a primer base and a colour for each step from one base to the next.

Adapters are small parameters. Matching runs in Arrow batches over the same kernels as in base space, with characters
compared as they are; 5' adapters that are anchored begin with the colour that leads from the read's primer to them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.functions.dna import COLOURS
from helixframe.operators.adapters import Adapter, match_batch
from helixframe.operators.modifiers import prepared

_COLOUR = {c[:2]: c[2] for c in COLOURS}
_NEXT = {c[0] + c[2]: c[1] for c in COLOURS}


def colours_of(bases: str) -> str:
    """The colours between neighbouring bases, one fewer than there are bases."""
    return "".join(_COLOUR.get(bases[i : i + 2], ".") for i in range(len(bases) - 1))


def recoloured(primer: str, last: str, colour: str) -> str:
    """The colour from the primer to the base that follows last by a colour; . if any of them is unknown."""
    return _COLOUR.get(primer + _NEXT.get(last + colour, "N"), ".")


def cut_colour_adapter(reads: DataFrame, adapter: Adapter) -> DataFrame:
    """Remove an adapter once from reads with a primer column; adds adapter_name and matches.

    The adapter is given in bases or, at the 3' end, in colours. Behind a 5' adapter the first colour is coded anew from
    the primer. Before a 3' adapter one more colour goes, as it leads into the adapter. Null and empty sequences and null
    primers pass: without a primer no anchored 5' adapter matches, and the first colour behind another is unknown.
    """
    bases = adapter.sequence if set(adapter.sequence) <= set("ACGT") else None
    front = adapter.where in ("front", "prefix")
    if adapter.where not in ("front", "prefix", "back", "suffix"):
        raise ValueError("an adapter in colour space lies at the front or at the back")
    if front and bases is None:
        raise ValueError("a 5' adapter in colour space is given in bases")
    plain = replace(adapter, sequence=colours_of(bases) if bases else adapter.sequence, adapter_wildcards=False, read_wildcards=False)
    if not (adapter.sequence if adapter.where == "prefix" else plain.sequence):
        raise ValueError("an adapter without a colour")
    reads = prepared(reads)
    if "primer" not in reads.columns:
        reads = reads.withColumn("primer", F.lit(None).cast("string"))
    names = reads.columns

    def matched(seqs: list[str], primers: list[str]) -> list[tuple | None]:
        if adapter.where != "prefix":
            return match_batch(plain, seqs)
        out: list[tuple | None] = [None] * len(seqs)
        for primer in set(primers) & set("ACGT"):
            at = [x for x, p in enumerate(primers) if p == primer]
            for x, g in zip(at, match_batch(replace(plain, sequence=colours_of(primer + bases)), [seqs[x] for x in at])):
                out[x] = g
        return out

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if not len(pdf):
                continue
            text = lambda c: [None if v is None or v != v else v for v in pdf[c]]
            seqs, quals, primers, found, matches = text("sequence"), text("qualities"), text("primer"), text("adapter_name"), [list(m) for m in pdf["matches"]]
            live = [x for x, s in enumerate(seqs) if s]
            for x, g in zip(live, matched([seqs[x] for x in live], [primers[x] or "" for x in live])):
                if g is None:
                    continue
                s, q = seqs[x], quals[x]
                matches[x].append({"adapter": adapter.name, "front": front, "astart": g[0], "astop": g[1], "rstart": g[2], "rstop": g[3], "matches": g[4], "errors": g[5], "length": len(s), "adjacent": "", "sequence": s, "qualities": q})
                found[x] = adapter.name
                if front:
                    after = s[g[3] : g[3] + 1]
                    seqs[x] = recoloured(primers[x] or "", bases[-1], after) + s[g[3] + 1 :] if after else ""
                    quals[x] = None if q is None else q[g[3] :]
                else:
                    stop = max(g[2] - 1, 0)
                    seqs[x], quals[x] = s[:stop], None if q is None else q[:stop]
            pdf = pdf.copy()
            pdf["sequence"], pdf["qualities"], pdf["adapter_name"], pdf["matches"] = seqs, quals, found, matches
            yield pdf[names]

    return reads.mapInPandas(rows, T.StructType(list(reads.schema.fields)))
