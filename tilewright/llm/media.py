"""Media columns: WAV stored and read by the wave module, short-time Fourier transforms, and spectral-peak pair
fingerprints stored as time-coded arrays. Everything is local to a row: no exchange."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, small_batches

#: Samples a second, and the block that payloads are padded to.
RATE, BLOCK = 8000, 64
#: Samples of a frame and from frame to frame; band edges in FFT bins; frames ahead that a peak is paired with.
FRAME, HOP, BANDS, FAN_OUT = 256, 128, (1, 8, 20, 44, 129), 3
#: Frames transformed at a time: bounds memory for recordings of any length.
FRAMES_AT_A_TIME = 4096
_WINDOW = np.hanning(FRAME).astype(np.float64)


def to_wav(payload: bytes) -> bytes:
    """Mono 8-bit WAV holding exactly these bytes as samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as w:
        return w.readframes(w.getnframes())


def peaks(samples: bytes) -> np.ndarray:
    """(frames, bands): the FFT bin of each band's peak, 0 where none stands out. Magnitudes are rounded before they are
    compared, so equal samples have equal peaks."""
    x = np.frombuffer(samples, np.uint8)
    n = 1 + max(0, -(-(len(x) - FRAME) // HOP))
    found = []
    for at in range(0, n, FRAMES_AT_A_TIME):
        m = min(n - at, FRAMES_AT_A_TIME)
        part = x[at * HOP : at * HOP + (m - 1) * HOP + FRAME].astype(np.float64) - 128
        part = np.pad(part, (0, (m - 1) * HOP + FRAME - len(part)))
        frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP]
        mag = np.rint(np.abs(np.fft.rfft(frames * _WINDOW, axis=1)) * 16)
        floor = mag[:, 1:].mean(axis=1)
        rows = np.arange(m)
        bands = []
        for lo, hi in zip(BANDS, BANDS[1:], strict=False):
            b = mag[:, lo:hi].argmax(axis=1) + lo
            bands.append(np.where(mag[rows, b] > 2 * floor, b, 0))
        found.append(np.stack(bands, axis=1))
    return np.concatenate(found)


def fingerprint(samples: bytes) -> np.ndarray:
    """Sorted int64: frame << 32 | band << 18 | bin << 10 | later bin << 2 | frames between, one for each pair of peaks."""
    p = peaks(samples).astype(np.int64)
    found = []
    for gap in range(1, min(FAN_OUT, len(p) - 1) + 1):
        a, b = p[:-gap], p[gap:]
        t, band = np.nonzero((a > 0) & (b > 0))
        found.append(t << 32 | band << 18 | a[t, band] << 10 | b[t, band] << 2 | gap)
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _store(batches):
    for b in batches:
        texts = b.column(1).cast(pa.binary()).to_pylist()
        media, n = [], []
        for t in texts:
            t = t or b""
            n.append(len(t))
            media.append(to_wav(t + bytes(max(BLOCK, -(-len(t) // BLOCK) * BLOCK) - len(t))))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])


def _features(batches):
    for b in batches:
        cols: list[list] = [[], [], [], [], []]
        for stored in b.column(2).to_pylist():
            payload = from_wav(stored)
            codes = fingerprint(payload)
            feature = f"{len(codes)}:{hashlib.sha256(codes.astype('<i8').tobytes()).hexdigest()}"
            for c, v in zip(cols, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), codes, feature), strict=True):
                c.append(v)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.string())
        yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["id", "n_bytes", "media", "payload_bytes", "payload_sha256", "tail_crc32", "fingerprint", "feature"])


def media_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, media``: each text's UTF-8 bytes, zero-padded to a positive multiple of 64, as a WAV. Null text
    counts as empty and gives 64 zero samples; a null id is kept as it is; other columns are not read; an empty table gives an
    empty result; repeated rows repeat."""
    small_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_store, "id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """What reading ``media`` back gives: payload size and digests, the time-coded ``fingerprint`` and its digest ``feature``."""
    return media.mapInArrow(_features, "id long, n_bytes long, media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, fingerprint array<bigint>, feature string")


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = media_features(media_column(documents(spark, sf_dir)))
    return f.select(
        F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32",
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature", "fingerprint",
    )
