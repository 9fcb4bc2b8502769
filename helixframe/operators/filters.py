"""Predicates over reads and pairs, and first-match routing as one CASE."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Predicate = Callable[[Callable[[str], Column]], Column]


def too_short(m: int) -> Predicate:
    return lambda c: F.length(c("sequence")) < m


def too_long(m: int) -> Predicate:
    return lambda c: F.length(c("sequence")) > m


def n_content(limit: float) -> Predicate:
    """Below 1.0 a share of the length (empty reads pass), else a count; n and N count."""

    def test(c):
        seq = c("sequence")
        n = F.length(F.regexp_replace(seq, "[^nN]", ""))
        return (F.length(seq) > 0) & (n / F.greatest(F.length(seq), F.lit(1)) > limit) if limit < 1.0 else n > int(limit)

    return test


def trimmed() -> Predicate:
    return lambda c: c("adapter_name").isNotNull()


def untrimmed() -> Predicate:
    return lambda c: c("adapter_name").isNull()


def merged() -> Predicate:
    return lambda c: F.coalesce(c("merged"), F.lit(False))


def single(p: Predicate, prefix: str = "") -> Column:
    return p(lambda name: F.col(f"{prefix}{name}"))


def paired(p: Predicate, min_affected: int = 1) -> Column:
    """any (1) or both (2) of the mates; a null r2 fails. min_affected 0: legacy mode, r1 alone."""
    one, two = single(p, "r1."), F.col("r2").isNull() | F.coalesce(single(p, "r2."), F.lit(True))
    return one if min_affected == 0 else one | two if min_affected == 1 else one & two


def route(reads: DataFrame, rules: Sequence[tuple[str, Column]], default: str = "main") -> DataFrame:
    """dest: the name of the first rule that holds, or the default."""
    dest = None
    for name, test in rules:
        dest = F.when(test, name) if dest is None else dest.when(test, name)
    return reads.withColumn("dest", F.lit(default) if dest is None else dest.otherwise(default))


def standard_rules(test: Callable[[Predicate], Column], *, merged_out=False, minimum=None, maximum=None, max_n=None, discard_trimmed=False, discard_untrimmed=False) -> list[tuple[str, Column]]:
    """The rules in force, in the order in which they are tried."""
    rules = []
    if merged_out:
        rules.append(("merged", single(merged(), "r1.")))
    if minimum:
        rules.append(("too_short", test(too_short(minimum))))
    if maximum is not None:
        rules.append(("too_long", test(too_long(maximum))))
    if max_n is not None and max_n >= 0:
        rules.append(("max_n", test(n_content(max_n))))
    if discard_trimmed:
        rules.append(("trimmed", test(trimmed())))
    if discard_untrimmed:
        rules.append(("untrimmed", test(untrimmed())))
    return rules
