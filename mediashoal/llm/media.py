"""Media columns: WAV files in a binary column, and spectral-peak pair fingerprints.

``encode`` stores bytes losslessly as the 8-bit samples of a mono WAV file, written by
the wave module; ``decode`` reads the stored files back with it. ``features`` takes the
short-time Fourier transform of the samples, keeps the peaks (bins over their two
neighbours in frequency, not under those in time, and well over their frame's mean), and pairs each peak
with the next ``FAN``: a pair is (frequency, frequency, frames between) packed into an
integer, with the frame of its first peak as its time code.

Nulls: a null text counts as empty. Bytes are padded with zeros to a positive multiple
of 64. A media value that is null or no such file decodes to null with no features.
Columns besides the id and text are not used, whatever their names; repeated rows and
null ids come back as they are; an empty table gives no rows. Frames are transformed in
blocks, so a very long text needs little memory besides its own bytes.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediashoal.storage import small_batches

UNIT = 64
RATE = 8000
FRAME = 256
HOP = 128
BLOCK = 2048
#: A peak is at least so many times the mean magnitude of its frame.
OVER_MEAN = 2.5
FAN = 3
MAX_GAP = 63
HANN = np.hanning(FRAME + 1)[:FRAME].astype(np.float32)


def pad(data: bytes) -> bytes:
    return data + bytes(-len(data) % UNIT or (0 if data else UNIT))


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes | None) -> bytes | None:
    try:
        with wave.open(io.BytesIO(media), "rb") as w:
            return w.readframes(w.getnframes()) if (w.getnchannels(), w.getsampwidth()) == (1, 1) else None
    except (wave.Error, EOFError, TypeError):
        return None


def peaks(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Frames and frequency bins of all peaks, in this order."""
    frames = max(1, -(-(len(payload) - FRAME) // HOP) + 1)
    samples = np.full((frames - 1) * HOP + FRAME, 128, np.uint8)
    samples[: len(payload)] = np.frombuffer(payload, np.uint8)
    at, bins = [], []
    for lo in range(0, frames, BLOCK):
        hi = min(frames, lo + BLOCK)
        first, last = max(0, lo - 1), min(frames, hi + 1)  # one frame more at both ends, as neighbours
        part = samples[first * HOP : (last - 1) * HOP + FRAME].astype(np.float32) - 128
        m = np.abs(np.fft.rfft(np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP] * HANN, axis=1)).astype(np.float32)
        m[:, 0] = 0
        own = m[lo - first : lo - first + hi - lo]
        ok = own[:, 1:-1] >= OVER_MEAN * own.mean(1, keepdims=True)
        ok &= (own[:, 1:-1] > own[:, :-2]) & (own[:, 1:-1] > own[:, 2:])
        if first < lo:
            ok &= own[:, 1:-1] >= m[: hi - lo, 1:-1]
        else:
            ok[1:] &= own[1:, 1:-1] >= own[:-1, 1:-1]
        if last > hi:
            ok &= own[:, 1:-1] >= m[lo - first + 1 :, 1:-1]
        else:
            ok[:-1] &= own[:-1, 1:-1] >= own[1:, 1:-1]
        t, f = np.nonzero(ok)
        at.append(t + lo)
        bins.append(f + 1)
    return np.concatenate(at), np.concatenate(bins)


def fingerprint(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Time codes and packed pairs, by time and then by the second peak."""
    t, f = peaks(payload)
    times, pairs, order = [], [], []
    for k in range(1, FAN + 1):
        gap = t[k:] - t[:-k]
        near = np.flatnonzero(gap <= MAX_GAP)
        times.append(t[:-k][near])
        pairs.append(f[:-k][near] << 14 | f[k:][near] << 6 | gap[near])
        order.append(near * FAN + k)
    by = np.argsort(np.concatenate(order), kind="stable")
    return np.concatenate(times)[by].astype(np.int32), np.concatenate(pairs)[by].astype(np.int32)


def encode(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``(ident, n_bytes, media)``: the text's UTF-8 bytes as a WAV file."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [t.encode() if t else b"" for t in batch.column(1).to_pylist()]
            made = [to_wav(pad(x)) for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array(made, pa.binary())], [ident, "n_bytes", "media"])

    rows = docs.select(F.col(ident).alias("_id"), F.col(text).cast("string").alias("_text"))
    return rows.mapInArrow(run, f"{ident} {docs.schema[ident].dataType.simpleString()}, n_bytes bigint, media binary")


def decode(stored: DataFrame, ident: str = "doc_id") -> DataFrame:
    """``(ident, n_bytes, media, payload, times, pairs)`` from the stored files."""
    small_batches(stored.sparkSession)

    def lists(arrays: list[np.ndarray]) -> pa.Array:
        offsets = np.zeros(len(arrays) + 1, np.int32)
        np.cumsum([len(x) for x in arrays], out=offsets[1:])
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else [], pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.zeros(0, np.int32), np.zeros(0, np.int32))
        for batch in batches:
            payloads = [from_wav(x) for x in batch.column(2).to_pylist()]
            found = [fingerprint(p) if p else none for p in payloads]
            columns = [*batch.columns, pa.array(payloads, pa.binary()), lists([x[0] for x in found]), lists([x[1] for x in found])]
            yield pa.RecordBatch.from_arrays(columns, [ident, "n_bytes", "media", "payload", "times", "pairs"])

    kind = stored.schema[ident].dataType.simpleString()
    return stored.select(ident, "n_bytes", "media").mapInArrow(run, f"{ident} {kind}, n_bytes bigint, media binary, payload binary, times array<int>, pairs array<int>")
