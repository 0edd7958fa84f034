"""Media columns: WAV bytes in a binary column, short-time Fourier transforms, and spectral-peak pair fingerprints.

A payload is stored losslessly as mono 8-bit PCM samples in a WAV container (``wav_column``), read back by the wave module
(``fingerprint_column``), cut into frames that overlap by half and transformed.  Each frame gives its strongest bin in each of four bands; peaks of
nearby frames are paired into codes.  A fingerprint is an array of 64-bit codes in time order:
``frame << 32 | band << 24 | bin << 16 | later bin << 8 | frames between``.

Null payloads count as empty; an empty payload is padded to one unit of zero bytes.  Repeated rows give equal values.
Silent frames (all bins equal to zero after removal of the mean) have no peaks; a text without peaks has an empty array.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT, RATE, FRAME, HOP, AHEAD = 64, 8000, 256, 128, 2
BANDS = ((1, 9), (9, 25), (25, 57), (57, 129))
#: Frames that are transformed at a time: bounds a worker's memory for payloads of any length.
BLOCK = 4096


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


_window = np.hanning(FRAME).astype(np.float32)


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The strongest bin (0: none) and its magnitude, for each frame and band."""
    x = np.frombuffer(samples, np.uint8)
    frames = 1 + max(0, -(-(len(x) - FRAME) // HOP))
    x = np.concatenate([x, np.full(FRAME + (frames - 1) * HOP - len(x), 128, np.uint8)])
    x = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    bins, power = np.zeros((len(x), len(BANDS)), np.int64), np.zeros((len(x), len(BANDS)), np.float32)
    for at in range(0, len(x), BLOCK):
        y = x[at : at + BLOCK].astype(np.float32)
        y = (y - y.mean(axis=1, keepdims=True)) * _window
        z = np.fft.rfft(y, axis=1)
        m = z.real**2 + z.imag**2
        for b, (lo, hi) in enumerate(BANDS):
            k = m[:, lo:hi].argmax(axis=1)
            p = m[np.arange(len(y)), lo + k]
            bins[at : at + len(y), b] = np.where(p > 1e-3, lo + k, 0)
            power[at : at + len(y), b] = p
    return bins, power


def fingerprint(samples: bytes) -> np.ndarray:
    return _codes(peaks(samples)[0])


def _codes(bins: np.ndarray) -> np.ndarray:
    codes = []
    for ahead in range(1, AHEAD + 1):
        if len(bins) <= ahead:
            break
        a, b = bins[:-ahead], bins[ahead:]
        frame = np.arange(len(a), dtype=np.int64)[:, None]
        band = np.arange(len(BANDS), dtype=np.int64)[None, :]
        code = frame << 32 | band << 24 | a << 16 | b << 8 | ahead
        codes.append(code[(a > 0) & (b > 0)])
    return np.sort(np.concatenate(codes)) if codes else np.zeros(0, np.int64)


def wav_column(df: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), unit: int = UNIT) -> DataFrame:
    """The kept columns, n_bytes and ``media``: the text's UTF-8 bytes, padded to whole units, as WAV bytes."""
    d = df.select(*keep, F.encode(F.coalesce(F.col(text), F.lit("")), "utf-8").alias("media"))
    schema = df.select(*keep, F.lit(0).cast("long").alias("n_bytes"), F.lit(b"").alias("media")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(len(keep)).to_pylist()
            media = [to_wav(r + bytes(-len(r) % unit or (unit if not r else 0))) for r in raw]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary())], names=[*keep, "n_bytes", "media"])

    return d.mapInArrow(run, schema)


def fingerprint_column(df: DataFrame, *, media: str = "media", keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """Read the media column back: digests of payload and container, frame count, and the fingerprint array in time order."""
    fields = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames long, n_pairs long, feature string, fingerprint array<long>"
    added = df.sparkSession.createDataFrame([], fields).schema
    schema = df.select(*keep).schema
    names = [*keep, *added.names]
    for f in added:
        schema = schema.add(f)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))
        for batch in batches:
            rows = []
            for m in batch.column(len(keep)):
                m = m.as_py()
                x = from_wav(m)
                bins, _ = peaks(x)
                codes, frames = _codes(bins), len(bins)
                digest = hashlib.sha256(codes.astype("<i8").tobytes()).hexdigest()[:32]
                row = (len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-UNIT:]), len(m), hashlib.sha256(m).hexdigest(), frames, len(codes), f"{frames}:{len(codes)}:{digest}")
                rows.append((*row, codes))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *(pa.array([r[i] for r in rows], t) for i, t in zip(range(len(added)), types, strict=True))], names=names)

    return df.select(*keep, F.col(media).alias("__media")).mapInArrow(run, schema)
