"""Toxicity classifier, regularised with counterfactuals.

A linear model scores the hashed words, word beginnings and beginnings that several different words share of a whole
text. Labelled texts that name a group are copied with the identity term swapped for others of its kind, and training
penalises the squared change of the score between the two, so that naming a group neutrally costs nothing.

A null text is the empty text; both get the score of no evidence. Each row is scored on its own, a text of any length as a
whole. A score of 0.5 is toxic. An id teaches once for each label it has, however often it is repeated in either table, by
the smallest of its texts; documents without a label teach nothing, and a row without an id counts as held out. Without any
label of either class all scores are near that class (near 0 with no labels at all). An empty table gives an empty table.
Extra columns are kept by score(), and those that have the names of its results are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import crc_mod, slices

#: Identity terms, exchangeable within a line. A parameter.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "african", "european"),
    ("immigrants", "refugees", "foreigners", "locals"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "ausländer"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "étrangers"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "extranjeros"),
)

#: Hash space of the features; those kept for the model at most; the smallest chi-square that keeps one.
BITS, MOST_FEATURES, LEAST_CHI2 = 22, 4096, 12.0
#: Labelled ids that teach, for each class at most: those that the hash of the id puts first.
TRAIN_PER_CLASS = 4000
#: Weight of the counterfactual penalty, of the squares of the weights, and the steps of training.
CF_WEIGHT, L2, STEPS = 1.0, 3e-5, 600
PREFIXES = (3, 4, 5, 6)
_WORD = re.compile(r"\w+")
_MASK = (1 << BITS) - 1


def _h(s: str) -> int:
    return xxhash.xxh32_intdigest(s.encode()) & _MASK


def word_features(word: str) -> tuple[int, list[int]]:
    """The word's own feature, and those of its beginnings."""
    return _h("w " + word), [_h("p " + word[:k]) for k in PREFIXES if len(word) >= k]


def _shared(p: int, n: int) -> int:
    """The feature of a beginning that n different words share."""
    return (p * 31 + n * 7919) & _MASK


def features(words: set[str], cache: dict[str, tuple[int, list[int]]]) -> np.ndarray:
    """All features of a set of words, in rising order."""
    if len(cache) > 300_000:
        cache.clear()
    own: list[int] = []
    starts: list[int] = []
    for w in words:
        f = cache.get(w)
        if f is None:
            f = cache[w] = word_features(w)
        own.append(f[0])
        starts += f[1]
    a = np.array(starts, np.int64)
    p, n = np.unique(a, return_counts=True)
    more = [p, (p[n >= 2] * 31 + 2 * 7919) & _MASK, (p[n >= 3] * 31 + 3 * 7919) & _MASK]
    return np.unique(np.concatenate([np.array(own, np.int64), *more])).astype(np.int32)


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def counterfactuals(words: set[str], identity: Sequence[Sequence[str]] = IDENTITY) -> list[set[str]]:
    """The set of words with the identity terms of a group swapped for each other: one set for each swap, as many as
    the sizes of the groups named add up to, less one each."""
    out = []
    for group in identity:
        named = [t for t in group if t in words]
        for turn in range(1, len(group)) if named else ():
            out.append((words - set(named)) | {group[(group.index(t) + turn) % len(group)] for t in named})
    return out


@dataclass
class Model:
    index: dict[int, int] = field(default_factory=dict)  # feature -> place
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -20.0

    def score_words(self, words: set[str], cache: dict) -> float:
        if len(cache) > 300_000:
            cache.clear()
        total, starts = self.bias, Counter()
        for w in words:
            f = cache.get(w)
            if f is None:
                own, begin = word_features(w)
                value = self.weights[self.index[own]] if own in self.index else 0.0
                kept = tuple(p for p in begin if p in self.index or _shared(p, 2) in self.index or _shared(p, 3) in self.index)
                f = cache[w] = (float(value), kept)
            total += f[0]
            if f[1]:
                starts.update(f[1])
        for p, n in starts.items():
            for q in (p, *(_shared(p, k) for k in (2, 3) if n >= k)):
                at = self.index.get(q)
                if at is not None:
                    total += float(self.weights[at])
        return total


def _chosen(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Features whose presence tells most about the label by chi-square."""
    size = 1 << BITS
    pos, neg = np.zeros(size, np.int32), np.zeros(size, np.int32)
    for r, t in zip(rows, y):
        (pos if t else neg)[r] += 1
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    seen = np.flatnonzero(pos + neg >= 2)
    a, b = pos[seen].astype(float), neg[seen].astype(float)
    c, d = n1 - a, n0 - b
    chi2 = (n1 + n0) * (a * d - b * c) ** 2 / np.maximum((a + b) * (c + d) * n1 * max(n0, 1), 1)
    # Only evidence for the label: its absence is what the rest of a long text cannot outvote.
    keep = (chi2 >= LEAST_CHI2) & (a * n0 > b * n1)
    seen, chi2 = seen[keep], chi2[keep]
    return np.sort(seen[np.lexsort((seen, -chi2))[:MOST_FEATURES]])


def _sparse(rows: list[np.ndarray], kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates (row, column) of the kept features."""
    at, col = [], []
    for i, r in enumerate(rows):
        j = np.searchsorted(kept, r)
        ok = j < len(kept)
        ok[ok] = kept[j[ok]] == r[ok]
        at.append(np.full(int(ok.sum()), i))
        col.append(j[ok])
    return (np.concatenate(at), np.concatenate(col)) if at else (np.zeros(0, int), np.zeros(0, int))


def train(rows: list[np.ndarray], labels: Sequence[int], pairs: Sequence[tuple[np.ndarray, np.ndarray]] = (), cf_weight: float = CF_WEIGHT, shares: Sequence[float] | None = None) -> Model:
    """rows: features of each text; pairs: features of a text and of its counterfactual; shares: weights of the pairs, 1
    each if None."""
    y = np.asarray(labels, float)
    if not len(y) or y.min() == y.max():
        return Model(bias=-20.0 if not len(y) or y.max() == 0 else 20.0)
    kept = _chosen(rows, y > 0)
    at, col = _sparse(rows, kept)
    one, two = _sparse([p[0] for p in pairs], kept), _sparse([p[1] for p in pairs], kept)
    n, k, np_ = len(y), len(kept), max(1, len(pairs))
    share = np.ones(np_) if shares is None or not len(pairs) else np.asarray(shares, float)
    w, b = np.zeros(k), float(np.log(y.mean() / (1 - y.mean())))
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) ** 0.5  # halfway to balanced classes
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, STEPS + 1):
        z = b + np.bincount(at, w[col], n)
        g = weight * (1 / (1 + np.exp(-z)) - y) / n
        grad = np.bincount(col, g[at], k) + 2 * L2 * w
        if len(pairs):
            d = share * (np.bincount(one[0], w[one[1]], np_) - np.bincount(two[0], w[two[1]], np_))
            grad += cf_weight * 2 / share.sum() * (np.bincount(one[1], d[one[0]], k) - np.bincount(two[1], d[two[0]], k))
        full = np.append(grad, g.sum())
        m, v = 0.9 * m + 0.1 * full, 0.999 * v + 0.001 * full * full
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return Model({int(f): i for i, f in enumerate(kept)}, w, b)


_SAMPLE = "label int, features binary, swapped array<binary>"


def _sample_rows(identity):
    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict = {}
        for pdf in frames:
            out = []
            for text, label in zip(pdf["text"], pdf["label"]):
                words = words_of(text)
                swapped = [features(c, cache).tobytes() for c in counterfactuals(words, identity)]
                out.append((int(label), features(words, cache).tobytes(), swapped))
            yield pd.DataFrame(out, columns=["label", "features", "swapped"])

    return rows


def drawn(labels: DataFrame, per_class: int = TRAIN_PER_CLASS) -> DataFrame:
    """doc_id, label: of each class the ids that their hash puts first, per_class at most; equal hashes by id."""
    ids = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "label").distinct()
    h = F.xxhash64("doc_id", F.lit(6))
    one, two = (ids.where(F.col("label") == k).orderBy(h, "doc_id").limit(per_class) for k in (0, 1))
    return one.unionByName(two)


def fit(docs: DataFrame, labels: DataFrame, identity=IDENTITY, per_class: int = TRAIN_PER_CLASS, cf_weight: float = CF_WEIGHT) -> Model:
    """docs: doc_id, text; labels: doc_id, label (0 or 1). Learns from per_class ids of each class at most.

    The draw is made on the labels alone; its ids, two times per_class at most, are broadcast to the texts, which stay where
    they are, and one row of features for each comes back.
    """
    use = drawn(labels, per_class)
    texts = docs.select("doc_id", "text").join(F.broadcast(use), "doc_id").groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    got = texts.select("text", "label").mapInPandas(_sample_rows(identity), _SAMPLE).toPandas()
    got = got.sort_values(["label", "features"], kind="stable")  # results don't depend on the order of partitions
    read = lambda b: np.frombuffer(bytes(b), np.int32)
    texts = [read(b) for b in got["features"]]
    pairs = [(t, read(s)) for t, swapped in zip(texts, got["swapped"]) for s in swapped]
    shares = [1 / len(swapped) for swapped in got["swapped"] for _ in swapped]  # each text counts once
    return train(texts, got["label"].tolist(), pairs, cf_weight, shares)


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, out: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The columns in keep (all), score and decision under the names in out; input columns of these names are replaced."""
    slim = docs.drop(*out)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in slim.columns if keep is None or c in keep]
    at, held = slim.columns.index(text_col), [slim.columns.index(c) for c in kept]
    schema = T.StructType([*[slim.schema[c] for c in kept], T.StructField(out[0], T.DoubleType()), T.StructField(out[1], T.IntegerType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            for part in slices(batch, at):
                z = np.array([shared.value.score_words(words_of(t.as_py()), cache) for t in part.column(at)])
                p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in held], pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32), pa.int32())], names=[*kept, *out])

    return slim.mapInArrow(rows, schema)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(crc_mod(id_col, 5) == 0, F.lit(True))


def learnt(docs: DataFrame, labels: DataFrame) -> Model:
    """The model that the labels outside the held-out fifth teach."""
    return fit(docs, labels.select("doc_id", F.col("toxic").cast("int").alias("label")).where(~held_out()))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = learnt(docs, labels)
    return score(docs.select("doc_id", held_out().alias("held_out"), "text"), model, keep=["doc_id", "held_out"])
