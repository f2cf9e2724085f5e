"""Audio columns: bytes kept as 8-bit WAV, and features of it as fixed-shape Arrow tensors with time spans.

Features: polyphase resampling to RATE, overlapping windows, log-mel filter banks, and segments of sound by an energy
threshold with hysteresis. Every document is worked on alone, so its values depend on nothing else.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches, table

UNIT = 64
STORED_RATE, UP, DOWN = 16_000, 5, 8
RATE = STORED_RATE * UP // DOWN
TAPS = 16
WINDOW, HOP, N_FFT, MELS = 250, 100, 256, 32
CLIP_FRAMES = 64
#: Stored log-mels are hundredths of a decade, as int16.
STEP = 0.01
#: Above the median frame, in dB: a segment starts over RISE and goes on while over FALL; shorter ones are dropped.
RISE, FALL, LEAST_FRAMES = 0.8, 0.1, 3
_FRAMES_AT_ONCE = 4096


def pad(data: bytes) -> bytes:
    """Zeros up to a positive multiple of UNIT."""
    return data + bytes(-len(data) % UNIT if data else UNIT)


def to_wav(payload: bytes, rate: int = STORED_RATE) -> bytes:
    """One channel of unsigned 8-bit samples; the payload is the data chunk, byte for byte."""
    odd = len(payload) % 2
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + odd, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + bytes(odd)


def from_wav(stored: bytes) -> tuple[bytes, int]:
    """Samples and rate; other chunks are passed over."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(stored):
        kind, size = struct.unpack_from("<4sI", stored, at)
        if kind == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", stored, at + 8)
            if (form, channels, bits) != (1, 1, 8):
                raise ValueError("only one channel of 8-bit samples is kept here")
        elif kind == b"data":
            return stored[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@lru_cache(maxsize=8)
def _phases(up: int, down: int, taps: int) -> np.ndarray:
    """A windowed low-pass for each phase, newest sample last."""
    cut = min(1.0, up / down)
    t = np.arange(up * taps) - (up * taps - 1) / 2
    h = cut * np.sinc(t / up * cut) * np.hamming(up * taps)
    h = h.reshape(taps, up).T[:, ::-1]
    return np.ascontiguousarray(h / h.sum(axis=1, keepdims=True))


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """Polyphase: output m is phase m * down % up of the filter over the taps inputs that end at m * down // up."""
    n = -(-len(x) * up // down)
    padded = np.concatenate((np.zeros(taps - 1), x, np.zeros(1)))
    windows = np.lib.stride_tricks.sliding_window_view(padded, taps)
    out, h = np.empty(n), _phases(up, down, taps)
    for first in range(min(up, n)):
        at, phase = first * down // up, first * down % up
        out[first::up] = windows[at : at + down * len(out[first::up]) : down] @ h[phase]
    return out


@lru_cache(maxsize=1)
def _mel_bank() -> np.ndarray:
    hz = np.linspace(0, RATE / 2, N_FFT // 2 + 1)
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(60), mel(RATE / 2), MELS + 2) / 2595) - 1)
    up = (hz[:, None] - edges[None, :-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[None, 2:] - hz[:, None]) / (edges[2:] - edges[1:-1])
    return np.clip(np.minimum(up, down), 0, None)


def log_mels(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """int16 log-mels (frames x MELS) and the energy of each frame in dB, of samples at RATE."""
    frames = 1 + max(0, -(-(len(x) - WINDOW) // HOP))
    padded = np.zeros((frames - 1) * HOP + WINDOW)
    padded[: len(x)] = x[: len(padded)]
    windows = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::HOP]
    mels, energy, hann = np.empty((frames, MELS), np.int16), np.empty(frames), np.hanning(WINDOW)
    for at in range(0, frames, _FRAMES_AT_ONCE):
        part = windows[at : at + _FRAMES_AT_ONCE]
        power = np.abs(np.fft.rfft(part * hann, N_FFT, axis=1)) ** 2
        mels[at : at + len(part)] = np.rint(np.log10(power @ _mel_bank() + 1e-10) / STEP)
        energy[at : at + len(part)] = 10 * np.log10((part**2).mean(axis=1) + 1e-10)
    return mels, energy


def segments(energy: np.ndarray, rise: float = RISE, fall: float = FALL, least: int = LEAST_FRAMES) -> list[tuple[int, int]]:
    """[first, last) frames: runs over the lower threshold that somewhere reach the higher one."""
    base = np.round(np.median(energy), 6) if len(energy) else 0.0
    over = np.concatenate(([False], energy >= base + fall, [False]))
    edges = np.flatnonzero(over[1:] != over[:-1])
    return [(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if b - a >= least and (energy[a:b] >= base + rise).any()]


def tensor_type() -> pa.DataType:
    return pa.fixed_shape_tensor(pa.int16(), (CLIP_FRAMES, MELS))


def to_clips(mels: np.ndarray) -> pa.Table:
    """Clips of CLIP_FRAMES frames, the last filled with zeros: a fixed-shape tensor, its time span, and how many frames count."""
    n = -(-len(mels) // CLIP_FRAMES)
    filled = np.zeros((n * CLIP_FRAMES, MELS), np.int16)
    filled[: len(mels)] = mels
    first = np.arange(n) * CLIP_FRAMES
    frames = np.minimum(len(mels) - first, CLIP_FRAMES)
    tensors = pa.FixedShapeTensorArray.from_numpy_ndarray(filled.reshape(n, CLIP_FRAMES, MELS))
    return pa.table({"tensor": tensors, "start_s": pa.array(first * HOP / RATE), "end_s": pa.array(((first + frames - 1) * HOP + WINDOW) / RATE), "frames": pa.array(frames, pa.int32())})


def to_ipc(clips: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, clips.schema) as writer:
        writer.write_table(clips)
    return sink.getvalue().to_pybytes()


def from_ipc(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.BufferReader(data)).read_all()


def analyse(stored: bytes) -> tuple[bytes, np.ndarray, list[tuple[float, float]]]:
    """The payload read back, its log-mels, and its segments as seconds."""
    payload, _ = from_wav(stored)
    mels, energy = log_mels(resample((np.frombuffer(payload, np.uint8) - 128.0) / 128.0))
    return payload, mels, [(a * HOP / RATE, ((b - 1) * HOP + WINDOW) / RATE) for a, b in segments(energy)]


def media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (WAV), clips (an Arrow stream of fixed-shape tensors with time spans), segments (start_s, end_s)."""

    def run(batches):
        for batch in small_batches(batches, 1):
            for i, text in enumerate(batch.column(1).to_pylist()):
                stored = to_wav(pad(text or b""))
                _, mels, spans = analyse(stored)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), pa.array([len(text or b"")], pa.int64()), pa.array([stored], pa.binary()), pa.array([to_ipc(to_clips(mels))], pa.binary()), pa.array([[{"start_s": a, "end_s": b} for a, b in spans]], pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())])))],
                    names=["doc_id", "n_bytes", "media", "clips", "segments"],
                )

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary, clips binary, segments array<struct<start_s: double, end_s: double>>")


def digest(text: bytes | None) -> tuple:
    """What features() returns of one text, all of it from the stored bytes: samples, tensors and the time spans of clips and segments."""
    stored = to_wav(pad(text or b""))
    payload, mels, spans = analyse(stored)
    clips = from_ipc(to_ipc(to_clips(mels)))
    h = hashlib.sha256()
    for batch in clips.to_batches():
        h.update(np.ascontiguousarray(batch.column("tensor").to_numpy_ndarray()).astype("<i2"))
        for c in ("start_s", "end_s"):
            h.update(batch.column(c).to_numpy().astype("<f8"))
        h.update(batch.column("frames").to_numpy().astype("<i4"))
    h.update(struct.pack(f"<{2 * len(spans)}d", *(t for s in spans for t in s)))
    feature = f"frames={len(mels)};clips={clips.num_rows};segments={len(spans)};sha256={h.hexdigest()}"
    return len(text or b""), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), feature


def features(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of every row.

    Null text is the empty text, whose payload is one unit of zeros. Equal texts give equal values, an empty table no
    rows; doc_id may be null; texts of any length are taken whole; other columns are not read.
    """
    kinds = (("n_bytes", pa.int64(), "long"), ("payload_bytes", pa.int64(), "long"), ("payload_sha256", pa.string(), "string"), ("tail_crc32", pa.int64(), "long"), ("media_bytes", pa.int64(), "long"), ("media_sha256", pa.string(), "string"), ("feature", pa.string(), "string"))

    def run(batches):
        for batch in small_batches(batches, 1):
            made = [digest(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([m[i] for m in made], kind) for i, (_, kind, _) in enumerate(kinds))], names=["doc_id", *(k for k, _, _ in kinds)])

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{k} {t}" for k, _, t in kinds))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(table(spark, sf_dir, "documents"))
