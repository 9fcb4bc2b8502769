"""Quality classifier from weak labels.

Overlapping heuristic labellers vote on each text (1 good, 0 poor, -1 no opinion). Expectation-maximisation over the
counts of all vote patterns estimates each labeller's accuracy; the posterior of a pattern is a soft label, and soft
labels train a hashed linear scorer that sees the words, their shapes and lengths and the text's ratios rather than the votes.

A null text is the empty text; it gets no votes but "too short", and a score. Each row is judged on its own, a text of any
length as a whole. A score of 0.5 is kept. Rows that agree in id and features teach the scorer as one and count each for
itself in the estimate; null ids are ids like others. Vote patterns are counted before they leave the executors: at most
3 ** labellers rows whatever the input. An empty table gives an empty table. Extra columns are not read.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import slices, stored

#: Rows that train the scorer at most: those that the hash of the id puts first.
TRAIN_ROWS = 6000
BITS, STEPS, RATE, L2 = 16, 300, 0.05, 1e-3
#: Rounds of expectation-maximisation, and the shift at which it stops.
EM_ROUNDS, EM_SHIFT = 200, 1e-7

RATIOS = ("symbols", "upper", "distinct", "top_word", "repeats", "stops", "bars", "length", "run", "bangs", "longest", "after")
_PLAIN = frozenset(".,;:!?'\"()-")
#: Bits of a character's kind.
_SYMBOL, _UPPER, _LETTER = 1, 2, 4


@functools.cache
def _kinds() -> np.ndarray:
    """For each code point whether it is a symbol, an upper-case letter, a letter."""
    table = np.zeros(0x110000, np.uint8)
    for code in range(len(table)):
        ch = chr(code)
        cat = unicodedata.category(ch)
        symbol = not (cat[0] in "LMN" or ch.isspace() or ch in _PLAIN)
        table[code] = symbol * _SYMBOL | (cat == "Lu") * _UPPER | (cat[0] == "L") * _LETTER
    return table


def _bin(f: str) -> int:
    return xxhash.xxh32_intdigest(f.encode()) & ((1 << BITS) - 1)


class _Shapes(dict):
    """What a character looks like."""

    def __missing__(self, ch: str) -> str:
        got = self[ch] = "A" if ch.isupper() else "a" if ch.isalpha() else "0" if ch.isdigit() else ch
        return got


_SHAPES = _Shapes()
_LENGTH_BINS = [_bin(f"n{k}") for k in range(21)]


@functools.lru_cache(100_000)
def _shape_bin(shape: str) -> int:
    return _bin("s" + shape)


class Words:
    """Numbers of the words met, and what is known of each: the number of its bare form, whether that is short, and the bins
    of the word, the shape of its ends and its length. Starts anew when it is full: bounded memory."""

    FULL = 300_000

    def __init__(self):
        self.number: dict[str, int] = {}
        self.bare: dict[str, int] = {}
        self.known = np.zeros((1 << 12, 5), np.int64)

    def numbers(self, run: list[str]) -> np.ndarray:
        if len(self.number) > self.FULL:
            self.__init__()
        try:
            return np.array([self.number[w] for w in run], np.int64)
        except KeyError:
            for w in run:
                if w not in self.number:
                    self._add(w)
            return np.array([self.number[w] for w in run], np.int64)

    def _add(self, w: str) -> None:
        n = self.number[w] = len(self.number)
        if n == len(self.known):
            self.known = np.concatenate([self.known, np.zeros_like(self.known)])
        bare = w.lower().strip(".,;:!?")
        shape = "".join(map(_SHAPES.__getitem__, w[:2] + w[-3:]))
        self.known[n] = self.bare.setdefault(bare, len(self.bare)), len(bare) <= 3, _bin("w" + bare), _shape_bin(shape), _LENGTH_BINS[min(len(w), 20)]


def looked_at(text: str | None, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The numbers that labellers and scorer look at, in the order of RATIOS, and what is known of each word."""
    text = text or ""
    run = text.split()
    n = len(run)
    if not n:
        return np.zeros(len(RATIOS)), np.zeros((0, 5), np.int64)
    number = words.numbers(run)
    known = words.known[number]
    kinds = np.bincount(_kinds()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)], minlength=8)
    count = lambda bit: int(kinds[[k for k in range(8) if k & bit]].sum())
    bare = np.bincount(np.unique(known[:, 0], return_inverse=True)[1])
    lines = [x for x in text.split("\n") if x.strip()]
    equal = number[1:] == number[:-1]
    ends = np.flatnonzero(np.concatenate([~equal, [True]]))
    pairs = len(np.unique(number[1:] * (len(words.number) + 1) + number[:-1]))
    ratios = [
        count(_SYMBOL) / len(text),
        count(_UPPER) / max(1, count(_LETTER)),
        len(bare) / n,
        int(bare.max()) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        int(known[:, 1].sum()) / n,
        text.count("|") / n,
        min(1.0, np.log1p(n) / 8),
        int(equal.sum()) / n,
        text.count("!") / n,
        min(20, int(np.diff(ends, prepend=-1).max())) / 20,
        pairs / max(1, n - 1),
    ]
    return np.array(ratios), known


def ratios(text: str | None) -> np.ndarray:
    return looked_at(text, Words())[0]


def votes(r: np.ndarray) -> tuple[int, ...]:
    """The labellers' opinions: 1, 0 or -1 for none."""
    x = dict(zip(RATIOS, r))

    def vote(poor: bool, good: bool) -> int:
        return 0 if poor else 1 if good else -1

    if not r.any():
        return (-1, -1, -1, -1, -1, -1, 0, -1, -1)
    # Shares of a few words say nothing about repetition.
    enough, long = x["length"] > np.log1p(12) / 8, x["length"] > np.log1p(40) / 8
    return (
        vote(x["symbols"] > 0.05, x["symbols"] < 0.01),
        vote(x["upper"] > 0.4 and enough, x["upper"] < 0.15),
        vote(x["top_word"] > 0.25 and enough, x["top_word"] < 0.12),
        vote(x["run"] > 0.1 and enough, x["run"] < 0.03 and long),
        vote(x["stops"] < 0.12 and long, x["stops"] > 0.25),
        vote(x["bars"] > 0.2 or x["bangs"] > 0.2, x["bars"] == 0 and x["bangs"] < 0.02),
        vote(False, long and x["repeats"] < 0.2),
        vote(x["longest"] >= 0.25, x["longest"] < 0.16 and long),
        vote(x["after"] < 0.4 and enough, x["after"] > 0.6 and long),
    )


@dataclass
class Labellers:
    prior: float
    good: np.ndarray  # for each labeller, the chance that a vote on a good text says good
    poor: np.ndarray  # the chance that a vote on a poor text says good

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Chance that a text with these votes is good. A labeller without an opinion says nothing."""
        yes, no = patterns == 1, patterns == 0
        odds = np.log(self.prior / (1 - self.prior)) + yes @ np.log(self.good / self.poor) + no @ np.log((1 - self.good) / (1 - self.poor))
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))

    def accuracies(self) -> np.ndarray:
        """Chance that a labeller with an opinion is right, by the model."""
        return self.prior * self.good + (1 - self.prior) * (1 - self.poor)


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray) -> Labellers:
    """Dawid and Skene's estimate from counts of vote patterns.

    It starts from the share of poor votes, counted thrice: each labeller knows a few kinds of poor text only, so that a
    vote for good means less than one for poor. The rounds settle how much less.
    """
    yes, no = (patterns == 1).astype(float), (patterns == 0).astype(float)
    q = np.clip((yes.sum(1) + 0.7) / (yes.sum(1) + 3 * no.sum(1) + 1), 0.05, 0.95)
    q = np.where(no.sum(1) > 0, np.minimum(q, 0.4), q)
    model = Labellers(0.7, np.full(patterns.shape[1], 0.7), np.full(patterns.shape[1], 0.3))
    for _ in range(EM_ROUNDS):
        g, p = counts * q, counts * (1 - q)
        prior = float(np.clip((g.sum() + 1) / (counts.sum() + 2), 1e-4, 1 - 1e-4))
        # One vote each way keeps the chances away from 0 and 1.
        model = Labellers(prior, (g @ yes + 1) / (g @ (yes + no) + 2), (p @ yes + 1) / (p @ (yes + no) + 2))
        new = model.posterior(patterns)
        if np.abs(new - q).max(initial=0) < EM_SHIFT:
            break
        q = new
    return model


#: Places of the ratios' steps, behind the words' bins.
_FINE = (1 << BITS) + 32 * np.arange(len(RATIOS))
SIZE = (1 << BITS) + 32 * len(RATIOS)


def hashed(known: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sparse features: bins in rising order and values. Shares of words, word shapes and lengths, then the ratios in fine
    and coarse steps."""
    bins = np.sort(known[:, 2:], axis=None)
    ends = np.flatnonzero(np.append(bins[1:] != bins[:-1], True)) if len(bins) else np.zeros(0, np.int64)
    counts = np.diff(ends, prepend=-1) / max(1, len(known))
    step = np.minimum(10, r * 20).astype(np.int64)
    keys = np.concatenate([bins[ends], np.stack([_FINE + step, _FINE + 16 + step // 3], axis=1).ravel()])
    return keys.astype(np.int32), np.concatenate([counts, np.ones(2 * len(RATIOS))]).astype(np.float32)


def train(rows: list[tuple[np.ndarray, np.ndarray]], soft: np.ndarray) -> np.ndarray:
    """Logistic regression on soft labels; the last weight is the bias."""
    size = SIZE
    n = max(1, len(rows))
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    if not rows:
        return w
    at = np.repeat(np.arange(n), [len(b) for b, _ in rows])
    col, val = np.concatenate([b for b, _ in rows]), np.concatenate([x for _, x in rows]).astype(float)
    for step in range(1, STEPS + 1):
        z = w[-1] + np.bincount(at, w[col] * val, n)
        g = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - soft) / n
        grad = np.append(np.bincount(col, g[at] * val, size) + L2 * w[:-1], g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return w


def score_of(w: np.ndarray, bins: np.ndarray, values: np.ndarray) -> float:
    return float(1 / (1 + np.exp(-np.clip(w[-1] + w[bins] @ values, -50, 50))))


def _voted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    kind = docs.schema[id_col].dataType

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in (part for whole in batches for part in slices(whole, 1)):
            v, b, x = [], [], []
            for text in batch.column(1):
                r, known = looked_at(text.as_py(), words)
                bins, values = hashed(known, r)
                v.append(votes(r))
                b.append(bins.tobytes())
                x.append(values.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(v, pa.list_(pa.int32())), pa.array(b, pa.binary()), pa.array(x, pa.binary())], names=["id", "votes", "bins", "vals"])

    schema = T.StructType([T.StructField("id", kind), T.StructField("votes", T.ArrayType(T.IntegerType())), T.StructField("bins", T.BinaryType()), T.StructField("vals", T.BinaryType())])
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(rows, schema)


@dataclass
class Fitted:
    labellers: Labellers
    weights: np.ndarray


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Fitted]:
    """(id, votes, posterior, score, keep) for each row, and what was learnt. keep: the score is 0.5 at least."""
    voted = stored(_voted(docs, id_col, text_col), "quality")
    n_votes = len(votes(np.ones(len(RATIOS))))
    counted = voted.groupBy("votes").count().limit(3**n_votes).toPandas()
    order = sorted(range(len(counted)), key=lambda i: list(counted["votes"][i]))
    patterns = np.array([list(counted["votes"][i]) for i in order], int).reshape(-1, n_votes)
    counts = counted["count"].to_numpy(float)[order]
    model = expectation_maximisation(patterns, counts)
    total = counts.sum()
    # Thinned by the hash before the order is looked at, so that no task holds more than some thousand rows.
    place = F.pmod(F.xxhash64("id", F.lit(8)), F.lit(1_000_000))
    near = voted.where(place < (2 * TRAIN_ROWS + 100) / max(total, 1) * 1_000_000).groupBy("id", "votes", "bins", "vals").agg(F.count(F.lit(1)).alias("n"))
    sample = near.orderBy(place, "id", "bins", "vals").limit(TRAIN_ROWS).toPandas()
    read = lambda b, x: (np.frombuffer(bytes(b), np.int32), np.frombuffer(bytes(x), np.float32))
    soft = model.posterior(np.array([list(v) for v in sample["votes"]], int).reshape(-1, n_votes)) if len(sample) else np.zeros(0)
    w = train([read(b, x) for b, x in zip(sample["bins"], sample["vals"])], soft)
    shared = docs.sparkSession.sparkContext.broadcast((model, w))

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, weights = shared.value
        for pdf in frames:
            if len(pdf):
                p = m.posterior(np.array([list(v) for v in pdf["votes"]], int))
                s = np.array([score_of(weights, *read(b, x)) for b, x in zip(pdf["bins"], pdf["vals"])])
                yield pd.DataFrame({"id": pdf["id"], "votes": pdf["votes"], "posterior": p, "score": s, "keep": s >= 0.5})

    kind = docs.schema[id_col].dataType.simpleString()
    out = voted.mapInPandas(rows, f"id {kind}, votes array<int>, posterior double, score double, keep boolean")
    return out.withColumnRenamed("id", id_col), Fitted(model, w)


def query(docs: DataFrame) -> DataFrame:
    """doc_id, votes (as text), posterior, score, keep for every document."""
    out, _ = classify(docs)
    return out.select("doc_id", F.concat_ws(",", F.transform("votes", lambda v: v.cast("string"))).alias("votes"), "posterior", "score", "keep")
