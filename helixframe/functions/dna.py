"""Scalar functions over sequences and qualities, all as Catalyst expressions.

Positions are 0-based and half-open, as in the records. Nulls give nulls; empty sequences give empty results or 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: IUPAC codes and their complements.
IUPAC, COMPLEMENT = "ACGTUMRWSYKVHDBNacgtumrwsykvhdbn", "TGCAAKYWSRMBDHVNtgcaakywsrmbdhvn"
#: The colour of two neighbouring bases, as first base, second base, colour.
COLOURS = ("AA0", "CC0", "GG0", "TT0", "AC1", "CA1", "GT1", "TG1", "AG2", "GA2", "CT2", "TC2", "AT3", "TA3", "CG3", "GC3")


def let(value: Column, use) -> Column:
    """use(value) with the value bound to a variable: inside a lambda an expression is computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def complement(seq: Column) -> Column:
    return F.translate(seq, IUPAC, COMPLEMENT)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def resolve(seq: Column, alphabet: str = "ACGTN", default: str = "N") -> Column:
    """Characters outside the alphabet become the default."""
    return F.regexp_replace(seq, f"[^{alphabet}]", default)


def slice_(text: Column, start: Column, stop: Column) -> Column:
    """text[start:stop] for 0 <= start; empty if start >= stop."""
    return F.when(stop > start, F.substring(text, (start + 1).cast("int"), (stop - start).cast("int"))).otherwise(F.when(text.isNotNull(), F.lit("")))


def count_chars(seq: Column, chars: str) -> Column:
    """How many characters of seq are among chars."""
    return F.length(seq) - F.length(F.translate(seq, chars, ""))


def gc_percent(seq: Column) -> Column:
    """GC share in percent, rounded half to even; null for an empty sequence."""
    n = F.length(seq)
    return F.when(n > 0, F.bround(count_chars(seq, "GC") * 100.0 / n, 0)).cast("int")


def complexity(seq: Column) -> Column:
    """Shannon entropy of A, C, G and T in bits, 0 to 2; letters are upper-cased, others count for the length only."""
    def entropy(up: Column, n: Column) -> Column:
        total = F.lit(0.0)
        for base in "ACGT":
            total = total - let(count_chars(up, base) / n, lambda f: F.when(f > 0, f * F.log2(f)).otherwise(F.lit(0.0)))
        return F.when(n > 0, total).otherwise(F.lit(0.0))

    return let(F.upper(seq), lambda up: let(F.length(seq), lambda n: entropy(up, n)))


def quality_values(quals: Column, base: int = 33) -> Column:
    """Array of Phred values."""
    chars = F.filter(F.split(quals, ""), lambda c: c != "")
    return F.transform(chars, lambda c: F.ascii(c) - base)


def mean_quality(quals: Column, base: int = 33) -> Column:
    """Mean Phred value, rounded half to even; null for an empty read."""
    n = F.length(quals)
    return F.when(n > 0, F.bround(F.aggregate(quality_values(quals, base), F.lit(0), lambda a, x: a + x) * 1.0 / n, 0)).cast("int")


def error_sum(quals: Column, base: int = 33) -> Column:
    """Sum of the error probabilities that the qualities state."""
    return F.aggregate(quality_values(quals, base), F.lit(0.0), lambda a, x: a + F.pow(F.lit(10.0), -x / F.lit(10.0)))


def bounds(start: Column, stop: Column) -> Column:
    """struct(start, stop) of what stays, each computed once; both 0 where nothing does."""
    none = lambda a, b: F.coalesce(a >= b, F.lit(False))
    pair = lambda a, b: F.struct(F.when(none(a, b), F.lit(0)).otherwise(a).alias("start"), F.when(none(a, b), F.lit(0)).otherwise(b).alias("stop"))
    return let(start, lambda a: let(stop, lambda b: pair(a, b)))


#: Elements that a trim looks at before it folds over a whole read.
_HEAD = 16


def _fold(steps: Column) -> Column:
    """struct(cut, done): how many elements to cut, the running sum's first largest value above 0 before the sum first falls
    below 0, and whether it did."""
    state = F.struct(F.lit(0).alias("i"), F.lit(0).alias("s"), F.lit(0).alias("top"), F.lit(0).alias("cut"), F.lit(False).alias("done"))

    def step(a: Column, x: Column) -> Column:
        s = a["s"] + x
        i = a["i"] + 1
        better = s > a["top"]
        moved = F.struct(i.alias("i"), s.alias("s"), F.when(better, s).otherwise(a["top"]).alias("top"), F.when(better, i).otherwise(a["cut"]).alias("cut"), (s < 0).alias("done"))
        return F.when(a["done"], a).otherwise(moved)

    return F.aggregate(steps, state, step, lambda a: F.struct(a["cut"].alias("cut"), a["done"].alias("done")))


def _cut_length(steps, n: Column) -> Column:
    """Elements to cut, steps(k) being those of the first k elements, or of all for None. Most scans end within the first
    elements; only where one doesn't the whole read is folded."""
    return let(_fold(steps(_HEAD)), lambda a: F.when(a["done"] | (n <= _HEAD), a["cut"]).otherwise(_fold(steps(None))["cut"]))


def _ends(text: Column, back: bool):
    """The first k characters from an end as an array, or all."""
    chars = lambda t: F.filter(F.split(t, ""), lambda c: c != "")
    if back:
        return lambda k: chars(F.reverse(text if k is None else F.substring(text, F.greatest(F.length(text) - k + 1, F.lit(1)), F.lit(k))))
    return lambda k: chars(text if k is None else F.substring(text, 1, k))


def quality_trim(quals: Column, front: int = 0, back: int = 10, base: int = 33) -> Column:
    """struct(start, stop) of what stays. Both scans see the whole read; start >= stop leaves nothing. Null without qualities."""
    n = F.length(quals)
    scan = lambda cutoff, end: _cut_length(lambda k: F.transform(_ends(quals, end)(k), lambda c: F.lit(cutoff + base) - F.ascii(c)), n)
    # No quality is below 0, so a cutoff of 0 cuts nothing.
    return bounds(scan(front, False) if front > 0 else F.lit(0), n - scan(back, True) if back > 0 else n)


def nextseq_trim(seq: Column, quals: Column, cutoff: int = 20, base: int = 33) -> Column:
    """As quality_trim at the 3' end, where G counts as one below the cutoff."""
    step = lambda c, x: F.when(c == "G", F.lit(1)).otherwise(F.lit(cutoff + base) - F.ascii(x))
    n = F.length(quals)
    return bounds(F.lit(0), n - _cut_length(lambda k: F.zip_with(_ends(seq, True)(k), _ends(quals, True)(k), step), n))


def n_end_trim(seq: Column) -> Column:
    """Without the runs of N at both ends."""
    return bounds(F.length(seq) - F.length(F.ltrim(seq, F.lit("N"))), F.length(F.rtrim(seq, F.lit("N"))))


def cut(seq: Column, lengths: list[int]) -> Column:
    """Unconditional cuts: positive lengths from the front, negative ones from the back."""
    front, back = sum(x for x in lengths if x > 0), -sum(x for x in lengths if x < 0)
    n = F.length(seq)
    return bounds(F.least(F.lit(front), n), F.greatest(n - back, F.lit(0)))


def min_cut(seq: Column, lengths: list[int], done_front: Column, done_back: Column) -> tuple[Column, Column]:
    """(start, stop) after cuts of only what is still missing from the wanted lengths."""
    front, back = sum(x for x in lengths if x > 0), -sum(x for x in lengths if x < 0)
    n = F.length(seq)
    return F.least(F.greatest(F.lit(front) - done_front, F.lit(0)), n), F.greatest(n - F.greatest(F.lit(back) - done_back, F.lit(0)), F.lit(0))


def length_tag(name: Column, seq: Column, tag: str) -> Column:
    """tag and any digits after it become tag and the length."""
    return F.regexp_replace(name, F.lit(rf"\b{tag}[0-9]*\b"), F.concat(F.lit(tag), F.length(seq).cast("string")))


def strip_suffixes(name: Column, suffixes: list[str]) -> Column:
    """Each suffix in turn, if the name ends with it."""
    for s in suffixes:
        name = F.when(name.endswith(s), F.substring(name, F.lit(1), F.length(name) - len(s))).otherwise(name)
    return name


def add_prefix_suffix(name: Column, prefix: str, suffix: str, adapter: Column) -> Column:
    """{name} stands for the adapter matched, or no_adapter."""
    put = lambda t: F.replace(F.lit(t), F.lit("{name}"), F.coalesce(adapter, F.lit("no_adapter")))
    return F.concat(put(prefix), name, put(suffix))


def double_encode(seq: Column) -> Column:
    return F.translate(seq, "0123.", "ACGTN")


def zero_cap(quals: Column, base: int = 33) -> Column:
    """Characters below the base become the base."""
    return F.translate(quals, "".join(map(chr, range(base))), chr(base) * base)


def colour_encode(seq: Column) -> Column:
    """First base, then one colour for each pair of neighbours; . where a base is unknown."""
    pairs = F.create_map(*[F.lit(x) for c in COLOURS for x in (c[:2], c[2])])
    steps = let(seq, lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 1, F.lit(1))), lambda i: F.coalesce(F.try_element_at(pairs, F.substring(s, i, F.lit(2))), F.lit("."))))
    return F.when(F.length(seq) < 2, seq).otherwise(F.concat(F.substring(seq, 1, 1), F.array_join(steps, "")))


def colour_decode(colours: Column) -> Column:
    """Bases from a first base and colours; N after an unknown colour."""
    table = F.create_map(*[F.lit(x) for c in COLOURS for x in (c[0] + c[2], c[1])])
    chars = F.filter(F.split(F.substring(colours, F.lit(2), F.length(colours)), ""), lambda c: c != "")
    first = F.substring(colours, 1, 1)
    fold = F.aggregate(chars, first, lambda a, c: F.concat(a, F.coalesce(F.try_element_at(table, F.concat(F.substring(a, -1, 1), c)), F.lit("N"))))
    return fold


def names_match(a: Column, b: Column) -> Column:
    """Names agree up to the first white space; a last 1 or 2 is left out if both have one."""
    first = lambda x: F.regexp_extract(x, r"^(\S*)", 1)
    p, q = first(a), first(b)
    bare = lambda x: F.regexp_replace(x, "[12]$", "")
    return F.when(p.rlike("[12]$") & q.rlike("[12]$"), bare(p) == bare(q)).otherwise(p == q)

