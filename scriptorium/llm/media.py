"""Media columns: bytes as 8-bit mono WAV, and spectral-peak pair fingerprints of its short-time Fourier transform."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scriptorium.llm.common import batch, bound_batches, texts_of, tidy

RATE = 8000
FRAME = 256
HOP = 256
#: Frequency bands, as first bins; the strongest bin of each band can be a peak.
BANDS = (2, 12, 28, 60, 129)
#: A band's strongest bin is a peak where it is so many times the frame's mean magnitude.
STRONG = 2.0
#: Each peak is paired with so many of the next ones, at most REACH frames later.
PAIRS, REACH = 2, 15
#: Samples transformed at a time, so that memory doesn't follow the length of a recording.
SLAB = 1 << 20


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as r:
        if (r.getnchannels(), r.getsampwidth()) != (1, 1):
            raise ValueError("not 8-bit mono")
        return r.readframes(r.getnframes())


_WINDOW = np.hanning(FRAME).astype(np.float32)


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frame, bin) of spectral peaks, by frame, then bin; the last frame is filled with silence."""
    n = max(1, -(-(len(samples) - FRAME) // HOP) + 1)
    at, found = [], []
    for first in range(0, n, SLAB // HOP):
        last = min(n, first + SLAB // HOP)
        part = samples[first * HOP : (last - 1) * HOP + FRAME].astype(np.float32) - 128
        part = np.pad(part, (0, (last - first - 1) * HOP + FRAME - len(part)))
        frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP]
        size = np.abs(np.fft.rfft(frames * _WINDOW, axis=1))
        mean = size.mean(axis=1)
        best = np.stack([size[:, a:b].argmax(axis=1) + a for a, b in zip(BANDS, BANDS[1:], strict=False)], axis=1)
        kept = np.take_along_axis(size, best, axis=1) >= STRONG * mean[:, None]
        kept &= mean[:, None] > 0
        t, k = np.nonzero(kept)
        at.append(t + first)
        found.append(best[t, k])
    return np.concatenate(at), np.concatenate(found)


def pair_codes(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frame, code) of pairs of peaks: the code holds both bins and the frames between them."""
    t, f = peaks(samples)
    times, codes = [], []
    for d in range(1, PAIRS + 1):
        gap = t[d:] - t[:-d] if len(t) > d else t[:0]
        near = gap <= REACH
        times.append(t[: len(gap)][near])
        codes.append((f[: len(gap)][near] << 12 | f[d : d + len(gap)][near] << 4 | gap[near]) if len(gap) else gap)
    times, codes = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((codes, times))
    return times[order], codes[order]


def feature_string(samples: np.ndarray) -> str:
    """Time-coded pairs: frames since the pair before in decimal, a colon and the code in hexadecimal, joined by commas."""
    t, codes = pair_codes(samples)
    return ",".join(f"{a}:{c:x}" for a, c in zip(np.diff(t, prepend=0).tolist(), codes.tolist(), strict=True))


def payload_of(text: str) -> tuple[int, bytes]:
    raw = text.encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % 64 if raw else 64)


_MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
_STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (a WAV file) of each text (null: empty); columns beside doc_id and text are left out."""
    bound_batches(docs.sparkSession)

    def store(batches):
        for b in batches:
            made = [payload_of(x) for x in b.column(1).to_pylist()]
            yield batch(_STORED, [b.column(0), [n for n, _ in made], [to_wav(p) for _, p in made]])

    return texts_of(docs).mapInArrow(tidy(store), "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Of each WAV file (doc_id, n_bytes, media): sizes, digests of file and payload, and the feature. Rows stay in their tasks."""

    def read(batches):
        for b in batches:
            rows = []
            for name, n, stored in zip(*(c.to_pylist() for c in b.columns), strict=True):
                payload = from_wav(stored)
                rows.append((name, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature_string(np.frombuffer(payload, np.uint8))))
            yield batch(_MEDIA, [*zip(*rows, strict=True)] if rows else [[]] * len(_MEDIA))

    return media.select("doc_id", "n_bytes", "media").mapInArrow(tidy(read), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
