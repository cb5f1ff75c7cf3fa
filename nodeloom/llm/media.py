"""Media columns: texts carried as sound files, with spectral-peak pair fingerprints.

The UTF-8 bytes of a text, filled up with zero bytes to a positive multiple of 64, are the samples
of an 8-bit mono WAV file. The file's bytes are read back by the ``wave`` module; a short-time
Fourier transform of the samples read gives, for each frame and each of four frequency bands, the
strongest bin. Every such peak is paired with peaks of the next three frames; a pair is coded as
(first bin, second bin, frames between) and stored with the frame it starts in, as two arrays.

Each document is transformed by itself in blocks of a fixed number of frames, so equal texts give
equal values wherever they stand, and memory is bounded by the longest single text.

Defined cases: null and empty texts are 64 zero bytes; repeated rows each get a row.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from nodeloom.llm._common import append_columns

RATE, ALIGN = 8_000, 64
FRAME, HOP, BLOCK = 128, 64, 8_192
#: Lower ends of the frequency bands, in bins; bin 0 is the mean and belongs to none.
BANDS = (1, 5, 14, 32)
REACH = 3
_WINDOW = np.hanning(FRAME).astype(np.float32)


def payload(text: str) -> tuple[bytes, int]:
    """The text's bytes with their padding, and their number without it."""
    data = text.encode("utf-8", "surrogatepass")
    return data + b"\0" * (-len(data) % ALIGN or (0 if data else ALIGN)), len(data)


def write_wav(data: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(RATE)
        f.writeframes(data)
    return out.getvalue()


def read_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as f:
        return f.readframes(f.getnframes())


def peaks(data: bytes) -> np.ndarray:
    """The bin of the peak of every frame (rows) and band (columns); -1 where there is none."""
    samples = np.zeros(len(data) + FRAME + 2 * HOP, np.float32)  # silence after the end: four frames at least
    samples[: len(data)] = np.frombuffer(data, np.uint8)
    samples[: len(data)] -= 128
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    found = []
    for i in range(0, len(frames), BLOCK):
        spectrum = np.fft.rfft(frames[i : i + BLOCK] * _WINDOW, axis=1)
        power = np.round(spectrum.real**2 + spectrum.imag**2, 2)
        inner, columns = power[:, 1:-1], []
        peak = np.zeros(power.shape, bool)
        peak[:, 1:-1] = (inner > power[:, :-2]) & (inner >= power[:, 2:])
        for a, b in zip(BANDS, (*BANDS[1:], power.shape[1]), strict=True):
            band = power[:, a:b]
            shown = np.where(peak[:, a:b] & (band > band.mean(1, keepdims=True)), band, -1)
            best = shown.argmax(1)
            columns.append((band.argmax(1) + a, np.where(shown[np.arange(len(best)), best] < 0, -1, best + a)))
        strongest, top = (np.stack(x, 1) for x in zip(*columns, strict=True))
        found.append(np.where((top < 0).all(1, keepdims=True), strongest, top))
    return np.concatenate(found)


def pairs(top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start frames and codes of all peak pairs, by start frame, then band, then distance."""
    times, codes = [], []
    bands = top.shape[1]
    for band in range(bands):
        for ahead in range(1, REACH + 1):
            first, second = top[:-ahead, band], top[ahead:, (band + ahead) % bands]
            both = np.flatnonzero((first >= 0) & (second >= 0))
            times.append(both)
            codes.append(first[both] << 12 | second[both] << 2 | ahead - 1)
    times, codes = np.concatenate(times), np.concatenate(codes)
    order = np.argsort(times, kind="stable")
    return times[order].astype("<u4"), codes[order].astype("<u4")


def media_columns(df: DataFrame, text_col: str = "text", with_media: bool = False) -> DataFrame:
    """Adds the digests of payload and file and a digest of the fingerprint; ``with_media`` adds file and arrays too."""

    def one(text: str):
        data, n = payload(text)
        media = write_wav(data)
        back = read_wav(media)
        times, codes = pairs(peaks(back))
        digest = hashlib.sha256(times.tobytes() + codes.tobytes()).hexdigest()
        row = [n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-ALIGN:]), len(media), hashlib.sha256(media).hexdigest(), f"{len(codes)}:{digest}"]
        return [*row, media, times, codes] if with_media else row

    def arrays(column) -> pa.Array:
        ends = np.cumsum([0, *map(len, column)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*column, np.empty(0, "<u4")]).astype(np.int32)))

    def make():
        def columns(texts):
            found = list(zip(*map(one, texts), strict=True)) or [[] for _ in fields]
            return [*found[:-2], arrays(found[-2]), arrays(found[-1])] if with_media else found

        return columns

    fields = [("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType())]
    fields += [("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType())]
    if with_media:
        fields += [("media", T.BinaryType()), ("peak_times", T.ArrayType(T.IntegerType())), ("peak_codes", T.ArrayType(T.IntegerType()))]
    return append_columns(df, text_col, fields, make)
