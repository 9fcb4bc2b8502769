"""Driver-side numbers: chances of random matches."""

from __future__ import annotations

from functools import lru_cache
from math import comb

import numpy as np


@lru_cache(maxsize=100_000)
def random_match(matches: int, size: int, match: float = 0.25, mismatch: float = 0.75) -> float:
    """Chance of so many matches or more among size random pairs of bases."""
    if matches == size:
        return match**matches
    return float(sum(comb(size, i) * match**i * mismatch ** (size - i) for i in range(matches, size + 1)))


def random_match_table(longest: int, match: float = 0.25, mismatch: float = 0.75) -> np.ndarray:
    """table[size, matches] for all sizes up to longest."""
    table = np.ones((longest + 1, longest + 1))
    for n in range(longest + 1):
        for k in range(n + 1):
            table[n, k] = random_match(k, n, match, mismatch)
    return table


def expected_hit(seq: str, gc: float = 0.5) -> float:
    """Chance of the sequence at a given place, from the share of G and C."""
    p = 1.0
    for c in seq:
        p *= gc / 2 if c in "GC" else (1 - gc) / 2 if c in "AT" else 1.0
    return p


def error_ranges(length: int, rate: float) -> list[tuple[int, int, int]]:
    """(errors, from length, to length): how many errors a match of a length may have."""
    out, start = [], 1
    for n in range(1, length + 2):
        allowed, before = int(n * rate), int((n - 1) * rate)
        if n > length or allowed != before:
            if n - 1 >= start:
                out.append((before, start, n - 1))
            start = n
    return out
