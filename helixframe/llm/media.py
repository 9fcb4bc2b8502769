"""Media columns: texts as WAV samples, short-time Fourier transforms and spectral-peak pair fingerprints.

Each row is worked on its own, so hot sources or repeated rows cost nothing extra. A null text is the empty text; an
empty payload is one block of padding. A text of any length is transformed some thousand frames at a time. Of peaks of equal
strength the lower bin counts. Null ids stay null; repeated rows give equal rows; an empty table gives an empty table.
Extra columns of the input are not read.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import slices

#: Padding unit in samples, also the length of a frame.
BLOCK = 576
PAD = b"\xff"
RATE = 8000
HOP = BLOCK // 2
#: Spectral peaks kept in each frame, and following frames that a peak pairs with.
PEAKS, FAN = 3, 2
#: Frames transformed at once: bounds the memory a very long text takes.
CHUNK = 4096

_WINDOW = np.hanning(BLOCK).astype(np.float32)


def padded(data: bytes) -> bytes:
    """data with bytes 255 appended up to a positive multiple of BLOCK."""
    want = max(1, -(-len(data) // BLOCK)) * BLOCK
    return data + PAD * (want - len(data))


def write_wav(payload: bytes, rate: int = RATE) -> bytes:
    """A mono WAV file whose 8-bit samples are the payload's bytes."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def read_wav(media: bytes) -> tuple[bytes, int]:
    """The samples and the rate of a WAV file."""
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("expected one channel of 8-bit samples")
        return w.readframes(w.getnframes()), w.getframerate()


def spectra(samples: bytes) -> Iterator[np.ndarray]:
    """Magnitudes of the short-time Fourier transform, some frames at a time: (frames, BLOCK // 2 + 1)."""
    x = (np.frombuffer(samples, dtype=np.uint8).astype(np.float32) - 128.0) / 128.0
    frames = np.lib.stride_tricks.sliding_window_view(x, BLOCK)[::HOP]
    for at in range(0, len(frames), CHUNK):
        yield np.abs(np.fft.rfft(frames[at : at + CHUNK] * _WINDOW, axis=1)).astype(np.float32)


def peaks(magnitudes: np.ndarray) -> np.ndarray:
    """The PEAKS strongest local maxima of each frame as bins in rising order; -1 where a frame has fewer."""
    inner = magnitudes[:, 1:-1]
    top = (inner > magnitudes[:, :-2]) & (inner >= magnitudes[:, 2:])
    # Rounded, so that the last bits of the transform decide no order; ties go to the lower bin.
    level = np.where(top, np.rint(inner.astype(np.float64) * 100), -1.0)
    level = level * 1024 + np.arange(level.shape[1], 0, -1)[None, :]
    best = np.argpartition(-level, PEAKS, axis=1)[:, :PEAKS]
    bins = np.where(np.take_along_axis(top, best, axis=1), best + 1, -1)
    return np.sort(bins, axis=1).astype(np.int64)


def fingerprint(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(times, hashes): pairs of peaks as anchor bin, partner bin and frames between, coded with the anchor's frame."""
    rows = np.concatenate([peaks(m) for m in spectra(samples)])
    times, hashes = [], []
    for gap in range(1, FAN + 1):
        a, b = rows[:-gap], rows[gap:]
        if not len(b):
            break
        left, right = np.repeat(a, PEAKS, axis=1), np.tile(b, (1, PEAKS))
        ok = (left >= 0) & (right >= 0)
        t = np.broadcast_to(np.arange(len(a))[:, None], ok.shape)
        times.append(t[ok])
        hashes.append((left[ok] << 20) | (right[ok] << 8) | gap)
    if not times:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    t, h = np.concatenate(times), np.concatenate(hashes)
    order = np.lexsort((h, t))
    return t[order].astype(np.int64), h[order].astype(np.int64)


_FIELDS = "n_bytes long, payload binary, media binary, sample_rate int, times array<int>, hashes array<int>"


def with_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes (unpadded), payload read back from the WAV, media (the WAV), sample_rate, times and hashes."""
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", batches_id), ("n_bytes", pa.int64()), ("payload", pa.binary()), ("media", pa.binary()), ("sample_rate", pa.int32()), ("times", pa.list_(pa.int32())), ("hashes", pa.list_(pa.int32()))])
        for batch in batches:
            for part in slices(batch, 1, rows=64):
                out = []
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    data = (text or "").encode()
                    media = write_wav(padded(data))
                    payload, rate = read_wav(media)
                    t, h = fingerprint(payload)
                    out.append((i, len(data), payload, media, rate, t, h))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    batches_id = pa.string() if kind == "string" else pa.int64()
    got = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(rows, f"id {'string' if kind == 'string' else 'bigint'}, {_FIELDS}")
    return got.withColumnRenamed("id", id_col)


def media_digest(docs: DataFrame) -> DataFrame:
    """One row per document with digests of what with_media() stores, and the fingerprint: hashes of peak pairs and the
    frames (times) of their anchors. Equal texts have equal values."""
    m = with_media(docs)
    return m.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat(F.size("hashes").cast("string"), F.lit(":"), F.lower(F.hex(F.xxhash64("times", "hashes")))).alias("feature"),
        F.size("hashes").cast("bigint").alias("n_pairs"),
        "sample_rate",
        "times",
        "hashes",
    )
