"""Media columns: payloads stored as WAV, read back by the wave module, and fingerprinted by spectral peaks.

A payload's bytes are the samples of an 8-bit mono WAV, which is lossless. A short-time Fourier transform
(Hann windows of 576 samples, half overlapping) gives spectra; the strongest bin of each of six bands in a
frame is a peak where it stands out from its band and from the neighbouring frames. Each peak pairs with the
next peaks within a few frames, and every pair is one 64-bit number: time | first bin | second bin | distance.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, table, text_or_empty

#: Payloads are padded with FILL to a positive multiple of FRAME bytes.
FRAME, HOP, FILL, RATE = 576, 288, 255, 8000
#: Bin edges of the bands; pairs reach over at most REACH frames, to FAN peaks.
BANDS, REACH, FAN = (2, 10, 22, 42, 78, 140, 289), 12, 3
BLOCK = 4096


def payload_of(text: str) -> bytes:
    data = text.encode()
    return data + bytes([FILL]) * (-len(data) % FRAME or (0 if data else FRAME))


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        if (r.getnchannels(), r.getsampwidth()) != (1, 1):
            raise ValueError("8-bit mono samples are expected")
        return r.readframes(r.getnframes())


WINDOW = np.hanning(FRAME).astype(np.float32)


def band_maxima(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each frame and band: the strongest bin and its log magnitude. Long samples go block by block."""
    x = (samples.astype(np.float32) - 128.0) / 128.0
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    bins = np.empty((len(frames), len(BANDS) - 1), dtype=np.int64)
    level = np.empty(bins.shape, dtype=np.float32)
    for at in range(0, len(frames), BLOCK):
        spectrum = np.abs(np.fft.rfft(frames[at : at + BLOCK] * WINDOW, axis=1))
        for b, (low, high) in enumerate(zip(BANDS, BANDS[1:], strict=False)):
            part = spectrum[:, low:high]
            best = part.argmax(axis=1)
            bins[at : at + BLOCK, b] = best + low
            level[at : at + BLOCK, b] = np.log1p(part[np.arange(len(part)), best])
    return bins, level


def peak_pairs(samples: np.ndarray) -> np.ndarray:
    """The fingerprint: pairs of spectral peaks as int64 codes, ordered by time."""
    bins, level = band_maxima(samples)
    padded = np.pad(level, ((1, 1), (0, 0)), constant_values=-1.0)
    stands_out = (level >= level.mean(axis=0)) & (level > padded[:-2]) & (level >= padded[2:])
    time, band = np.nonzero(stands_out)
    bin_ = bins[time, band]
    codes = []
    for step in range(1, FAN + 1):
        if step >= len(time):
            break
        apart = time[step:] - time[:-step]
        near = apart <= REACH
        codes.append(((time[:-step] << 32) | (bin_[:-step] << 20) | (bin_[step:] << 8) | apart)[near])
    return np.sort(np.concatenate(codes)) if codes else np.empty(0, dtype=np.int64)


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", media: bool = False, pairs: bool = False) -> DataFrame:
    """Every text as a WAV payload, with digests of what was read back from the stored form.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature
    (frames, pairs and a digest of the pairs), and on request ``media`` binary (the WAV itself) and ``pairs``
    array<bigint>. A null or empty text is one frame of fill; a text with fewer than two peaks has no pairs.
    Equal texts give equal values, repeated rows repeat. No shuffle; other columns are ignored.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    schema += ", media binary" * media + ", pairs array<bigint>" * pairs

    def make():
        def step(columns):
            out = []
            for doc_id, text in zip(*columns, strict=True):
                stored = to_wav(payload_of(text))
                payload = from_wav(stored)
                found = peak_pairs(np.frombuffer(payload, dtype=np.uint8))
                digest = hashlib.sha256(found.astype("<i8").tobytes()).hexdigest()
                row = [doc_id, len(text.encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), f"{len(payload) // HOP - 1}:{len(found)}:{digest}"]
                out.append(row + [stored] * media + [found] * pairs)
            return list(zip(*out, strict=True)) if out else [[]] * (8 + media + pairs)

        return step

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")), make, schema)


def op1_wav_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(table(spark, sf_dir, "documents"), media=True, pairs=True)


QUERIES = {"op1_wav_peaks": op1_wav_peaks}
SQL: dict[str, str] = {}
