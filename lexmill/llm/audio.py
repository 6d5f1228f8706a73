"""Media columns: texts as WAV samples, short-time spectra, and fingerprints of spectral-peak pairs as time-coded arrays."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, texts_of

RATE = 8000
FRAME = HOP = 128  # frames side by side
AHEAD = 2
_BLOCK = 4096  # frames that are transformed at a time

SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "feature string, fingerprint array<long>"
)


def to_wav(payload: bytes) -> bytes:
    """One channel of 8-bit samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frame, bin): in each frame the strongest bin of each of four bands, where it is at least its time neighbours' and not silent.

    Block by block, so that memory doesn't grow with the length.
    """
    window = np.hanning(FRAME).astype(np.float32)
    n = max(1, -(-len(samples) // HOP))
    edges = np.array([1, 5, 13, 29, FRAME // 2 + 1])
    times, bins = [], []
    for at in range(0, n, _BLOCK):
        first, last = max(0, at - 1), min(n, at + _BLOCK + 1)
        x = np.zeros((last - first) * HOP, dtype=np.float32)
        own = samples[first * HOP : last * HOP]
        x[: len(own)] = own
        x[1 : len(own)] -= 0.95 * own[:-1].astype(np.float32)  # pre-emphasis
        x[0] -= 0.95 * (samples[first * HOP - 1] if first else 0)
        spectrum = np.abs(np.fft.rfft(x.reshape(-1, FRAME) * window, axis=1)).astype(np.float32)
        before = np.vstack([np.zeros_like(spectrum[:1]), spectrum[:-1]])
        after = np.vstack([spectrum[1:], np.zeros_like(spectrum[:1])])
        inner = slice(at - first, at - first + min(_BLOCK, n - at))
        rows = np.arange(inner.start, inner.stop)
        for low, high in zip(edges, edges[1:]):
            top = low + np.argmax(spectrum[inner, low:high], axis=1)
            level = spectrum[rows, top]
            ok = (level > 1.0) & (level >= before[rows, top]) & (level >= after[rows, top])
            times.append(rows[ok] + first)
            bins.append(top[ok])
    t, b = np.concatenate(times), np.concatenate(bins)
    order = np.lexsort((b, t))
    return t[order], b[order]


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """Each peak paired with the next two: time << 24 | first bin << 16 | second bin << 8 | frames between (at most 255)."""
    t, b = peaks(samples)
    codes = []
    for k in range(1, AHEAD + 1):
        gap = np.minimum(t[k:] - t[:-k], 255)
        codes.append((t[:-k] << 24) | (b[:-k] << 16) | (b[k:] << 8) | gap)
    return np.sort(np.concatenate(codes)).astype(np.int64)


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, most=1 << 22):
            rows = []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), texts_of(part)):
                media = to_wav(text.ljust(max(64, -(-len(text) // 64) * 64), b"\0"))
                back = from_wav(media)
                codes = fingerprint(np.frombuffer(back, dtype=np.uint8))
                rows.append(
                    (
                        doc_id, len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media),
                        hashlib.sha256(media).hexdigest(), f"{len(codes)}:{hashlib.sha256(codes.tobytes()).hexdigest()[:16]}", codes,
                    )
                )
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64())]
            names = [c.strip().split(" ")[0] for c in SCHEMA.split(",")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def media_columns(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> one row per document, repeated rows included; see ``SCHEMA``.

    A text is UTF-8 bytes (null: none), padded with zero bytes up to the next positive multiple of 64
    (none where the length is one, 64 for an empty text), stored as a WAV of 8-bit samples and read back; everything from payload_bytes on comes from what was read.
    feature: number of fingerprint codes and a digest of them. Equal texts give equal values. No shuffle; an empty table gives no rows.
    """
    return docs.select("doc_id", "text").mapInArrow(_columns, SCHEMA)
