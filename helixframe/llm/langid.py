"""Language identification by a byte convolutional network, trained here in numpy.

Bytes are embedded, filters of several widths slide over fixed-length windows, the maximum of each filter over a window
feeds a softmax. A text is cut into windows from end to end, none left out, and the mean of the windows' log
probabilities, by their lengths, decides.

A null text, or one without a letter, gets "und" with score 0. Each row is judged on its own, whatever its source, and a
text of any length by all of its windows, some at a time. Documents without a label teach nothing; where no labelled row
can teach (an empty table), all is "und". A row without an id counts as held out. Repeated rows teach as one and are judged
alike. Of equal probabilities the language first in code-point order is named. Extra columns are kept by predict(), and
those that have the names of its results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import crc_mod, slices

WINDOW = 256
WIDTHS = (2, 3, 4, 5)
FILTERS, DIM = 8, 8
#: Rows that teach: for each language at most, and in all (but one for each language whatever their number). Windows that
#: each of them teaches with, cut from anywhere in its whole text.
TRAIN_PER_LANG, TRAIN_ROWS, ROW_WINDOWS = 400, 8000, 8
STEPS, BATCH, RATE = 500, 64, 4e-3
UNKNOWN = "und"
#: Windows that pass through the network at once: bounds memory whatever a text's length.
CHUNK = 256

_LETTER = regex.compile(r"\p{L}")


@dataclass
class ByteCNN:
    """emb: (256, DIM); conv: (widest * DIM, filters), rows beyond a filter's width are 0; out: (filters, languages)."""

    langs: list[str]
    emb: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def hidden(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest value of each filter over each window, and the place of it. windows: (n, WINDOW) of bytes."""
        n, widest = len(windows), max(WIDTHS)
        tail = np.zeros((n, widest - 1), np.uint8)
        x = self.emb[np.concatenate([windows, tail], axis=1)]
        cols = np.lib.stride_tricks.sliding_window_view(x.reshape(n, -1), widest * DIM, axis=1)[:, ::DIM]
        act = (cols.reshape(-1, widest * DIM) @ self.conv).reshape(n, WINDOW, -1)
        at = act.argmax(axis=1)
        return np.take_along_axis(act, at[:, None, :], axis=1)[:, 0] + self.bias, at

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        h, _ = self.hidden(windows)
        z = np.maximum(h, 0) @ self.out + self.out_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def windows_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the text, the last padded with zeros, and their lengths."""
    n = max(1, -(-len(data) // WINDOW))
    w = np.frombuffer(data.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)
    length = np.full(n, WINDOW, np.float32)
    length[-1] = max(1, len(data) - (n - 1) * WINDOW)
    return w, length


def teaching_windows(text: str) -> list[bytes]:
    """ROW_WINDOWS parts of a text at places that its hash draws evenly over all of it. Half of them are a window long; the
    others are shorter, so that short texts are known too."""
    data = text.encode()
    rng = np.random.default_rng(xxhash.xxh64_intdigest(data))
    out = []
    for k in range(ROW_WINDOWS):
        n = WINDOW if k % 2 else int(rng.integers(8, WINDOW))
        at = int(rng.integers(0, max(1, len(data) - n + 1)))
        out.append(data[at : at + n])
    return out


def train(windows: list[bytes], langs: list[str], steps: int = STEPS, seed: int = 7) -> ByteCNN:
    """Adam on windows drawn at random, as many of each language."""
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    widest, total = max(WIDTHS), FILTERS * len(WIDTHS)
    mask = np.zeros((widest * DIM, total), np.float32)
    for k, w in enumerate(WIDTHS):
        mask[: w * DIM, k * FILTERS : (k + 1) * FILTERS] = 1
    par = {
        "emb": rng.normal(0, 0.5, (256, DIM)),
        "conv": rng.normal(0, 0.3, mask.shape) * mask,
        "bias": np.zeros(total),
        "out": rng.normal(0, 0.3, (total, len(names))),
        "out_bias": np.zeros(len(names)),
    }
    par = {k: v.astype(np.float32) for k, v in par.items()}
    net = ByteCNN(names, **par)
    if len(names) < 2:
        return net
    by = [[d for d, g in zip(windows, langs) if g == name] for name in names]
    m, v = {k: np.zeros_like(x) for k, x in par.items()}, {k: np.zeros_like(x) for k, x in par.items()}
    for step in range(1, steps + 1):
        y = rng.integers(0, len(names), BATCH)
        x = np.zeros((BATCH, WINDOW), np.uint8)
        for r, lang in enumerate(y):
            part = by[lang][rng.integers(len(by[lang]))]
            x[r, : len(part)] = np.frombuffer(part, np.uint8)
        h, at = net.hidden(x)
        a = np.maximum(h, 0)
        z = a @ net.out + net.out_bias
        z -= z.max(axis=1, keepdims=True)
        dz = np.exp(z)
        dz /= dz.sum(axis=1, keepdims=True)
        dz[np.arange(BATCH), y] -= 1
        dz /= BATCH
        dh = (dz @ net.out.T) * (h > 0)
        padded = np.concatenate([x, np.zeros((BATCH, widest - 1), np.uint8)], axis=1)
        seen = np.take_along_axis(padded[:, None, :], at[:, :, None] + np.arange(widest)[None, None, :], axis=2)
        patch = net.emb[seen].reshape(BATCH, total, widest * DIM)
        grad = {"out": a.T @ dz, "out_bias": dz.sum(0), "bias": dh.sum(0), "conv": np.einsum("bfk,bf->kf", patch, dh) * mask}
        dpatch = (dh[:, :, None] * net.conv.T[None]).reshape(-1, DIM)
        grad["emb"] = np.zeros_like(net.emb)
        np.add.at(grad["emb"], seen.reshape(-1), dpatch)
        for k, g in grad.items():
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            par[k] -= (RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def classify(net: ByteCNN, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and probability of each whole text."""
    data = [(t or "").encode() for t in texts]
    sums = np.zeros((len(texts), max(1, len(net.langs))), np.float64)
    weight = np.zeros(len(texts))
    wait: list[tuple[int, np.ndarray, np.ndarray]] = []
    held = 0

    def through() -> None:
        nonlocal held, wait
        if not wait:
            return
        owner = np.concatenate([np.full(len(w), i) for i, w, _ in wait])
        w, length = np.concatenate([w for _, w, _ in wait]), np.concatenate([n for _, _, n in wait])
        for at in range(0, len(w), CHUNK):
            s = slice(at, at + CHUNK)
            np.add.at(sums, owner[s], net.log_probabilities(w[s]) * length[s, None])
            np.add.at(weight, owner[s], length[s])
        wait, held = [], 0

    known = [bool(net.langs) and t is not None and _LETTER.search(t) is not None for t in texts]
    for i, d in enumerate(data):
        if known[i]:
            w, n = windows_of(d)
            wait.append((i, w, n))
            held += len(w)
            if held >= CHUNK:
                through()
    through()
    names, scores = [], []
    for i, ok in enumerate(known):
        if not ok:
            names.append(UNKNOWN)
            scores.append(0.0)
            continue
        mean = sums[i] / weight[i]
        p = np.exp(mean - mean.max())
        p /= p.sum()
        names.append(net.langs[int(p.argmax())])
        scores.append(float(p.max()))
    return names, scores


def training_windows(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> tuple[list[bytes], list[str]]:
    """Windows of a bounded sample of labelled rows, and their languages.

    Of each language the rows that the hash of the id puts first teach, then the smaller id, then the smaller text;
    rows that agree in all three teach once. The rows are thinned by the hash first, so that no window function meets more
    than a few hundred rows of a language; what is cut from a text comes to the driver, not the text.
    """
    own = docs.select(docs[id_col].alias("i"), docs[lang_col].alias("l"), docs[text_col].alias("t")).where(F.col("l").isNotNull() & (F.length(F.trim("t")) > 0))
    # A language is a column of the network, so that one row for each of them fits the driver or no network does.
    different = own.select("l", "i", F.xxhash64("t")).distinct()
    counts = [tuple(r) for r in different.groupBy("l").count().collect()]
    share = min(TRAIN_PER_LANG, max(1, TRAIN_ROWS // max(1, len(counts))))
    rates = F.broadcast(docs.sparkSession.createDataFrame([(lang, (2 * share + 100) / n * 1_000_000) for lang, n in counts], "of string, rate double"))
    h = F.xxhash64("i", F.lit(9))
    few = own.join(rates, F.col("l") == F.col("of")).where(F.pmod(h, F.lit(1_000_000)) < F.col("rate"))
    few = few.groupBy("l", "i", F.xxhash64("t").alias("same")).agg(F.min("t").alias("t"))
    rank = F.row_number().over(Window.partitionBy("l").orderBy(F.pmod(h, F.lit(1_000_000)), h, "i", "t"))
    few = few.withColumn("rank", rank).where(F.col("rank") <= share).select("l", "rank", "t")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [teaching_windows(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.list_(pa.binary()))], names=["l", "rank", "w"])

    got = few.mapInArrow(rows, "l string, rank int, w array<binary>").orderBy("l", "rank").toPandas()
    return [bytes(x) for w in got["w"] for x in w], [lang for lang, w in zip(got["l"], got["w"]) for _ in w]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out=None) -> ByteCNN:
    """Train on the rows for which held_out (a boolean column) is false."""
    rows = docs if held_out is None else docs.where(~held_out)
    return train(*training_windows(rows, id_col, text_col, lang_col))


def predict(docs: DataFrame, net: ByteCNN, text_col: str = "text", keep: list[str] | None = None, out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns in keep (all), language and score under the names in out; input columns of these names are replaced."""
    slim = docs.drop(*out)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    kept = [c for c in slim.columns if keep is None or c in keep]
    at, held = slim.columns.index(text_col), [slim.columns.index(c) for c in kept]
    schema = T.StructType([*[slim.schema[c] for c in kept], T.StructField(out[0], T.StringType()), T.StructField(out[1], T.DoubleType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                names, scores = classify(shared.value, part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in held], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*kept, *out])

    return slim.mapInArrow(rows, schema)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(crc_mod(id_col, 4) == 2, F.lit(True))


def query(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; learns from the rows that are not held out."""
    net = fit(docs.select("doc_id", "text", "lang"), held_out=held_out())
    slim = docs.select("doc_id", held_out().alias("held_out"), "text")
    return predict(slim, net, keep=["doc_id", "held_out"])
