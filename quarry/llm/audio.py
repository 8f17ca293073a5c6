"""Media columns: texts or samples kept losslessly as 8-bit WAV, with audio features computed from the stored bytes.

Features of one recording: samples are resampled by a polyphase filter from 16 kHz to 12 kHz (3/4), cut into overlapping
Hann frames of 256 samples every 192 (the last one filled up with silence), taken through a mel filterbank and a logarithm, and segmented by energy with two
thresholds (a segment opens above the high one and closes below the low one). The log-mel frames become one Arrow array
of fixed-shape tensors (blocks of 16 frames x 20 bands, the last one padded with the floor), the segments a list of time
spans. Long recordings are worked through in pieces; only the frames of one recording are held.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches

RATE, UP, DOWN, TAPS = 16_000, 3, 4, 12
FRAME, HOP, BANDS, BLOCK = 256, 192, 20, 16
UNIT, HEADER = 192, 44
FLOOR = np.float32(-10.0)
#: Thresholds of a frame's mean log-mel value, in standard deviations of the recording's frames about their mean.
HIGH, LOW = 0.5, -0.5
PIECE = 1 << 18


@functools.cache
def filters() -> np.ndarray:
    """The UP phases of a windowed-sinc low-pass, each of TAPS taps with gain one."""
    n = UP * TAPS
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / DOWN) * np.hamming(n)
    phases = np.stack([h[p::UP] for p in range(UP)])
    return (phases / phases.sum(axis=1, keepdims=True)).astype(np.float32)


@functools.cache
def mel_bank() -> np.ndarray:
    """FRAME/2+1 x BANDS triangles, equally spaced in mel between 0 and half the new rate."""
    rate = RATE * UP / DOWN
    mel = np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), BANDS + 2)
    hz = 700 * (10 ** (mel / 2595) - 1)
    f = np.arange(FRAME // 2 + 1) * rate / FRAME
    up = (f[:, None] - hz[None, :-2]) / (hz[1:-1] - hz[:-2])
    down = (hz[None, 2:] - f[:, None]) / (hz[2:] - hz[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


def wav(payload: bytes) -> bytes:
    """payload as unsigned 8-bit mono PCM in a RIFF container; its length must be even."""
    n = len(payload)
    head = b"RIFF" + (36 + n).to_bytes(4, "little") + b"WAVEfmt " + (16).to_bytes(4, "little")
    head += (1).to_bytes(2, "little") + (1).to_bytes(2, "little") + RATE.to_bytes(4, "little") * 2
    return head + (1).to_bytes(2, "little") + (8).to_bytes(2, "little") + b"data" + n.to_bytes(4, "little") + payload


def samples(media: bytes) -> bytes:
    """The samples of a WAV made by wav()."""
    if media[:4] != b"RIFF" or media[36:40] != b"data":
        raise ValueError("not an 8-bit WAV of this module")
    return media[HEADER : HEADER + int.from_bytes(media[40:44], "little")]


def encode(text: str | None) -> bytes:
    """A text's UTF-8 bytes, padded with spaces to a positive multiple of UNIT, as WAV."""
    raw = (text or "").encode()
    return wav(raw + b" " * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw)))


def resample(x: np.ndarray) -> np.ndarray:
    """x at UP/DOWN times its rate; the ends are padded with the edge samples."""
    h = filters()
    n = -(-len(x) * UP // DOWN)
    padded = np.concatenate([np.full(TAPS, x[0], x.dtype), x, np.full(TAPS, x[-1], x.dtype)])
    view = np.lib.stride_tricks.sliding_window_view(padded, TAPS)
    out = np.empty(n, np.float32)
    for r in range(UP):  # outputs r, r+UP, ... share a phase and step DOWN inputs each
        phase, first = (r * DOWN) % UP, (r * DOWN) // UP
        mine = out[r::UP]
        rows = view[TAPS // 2 + first :: DOWN][: len(mine)]
        for i in range(0, len(mine), PIECE):
            mine[i : i + PIECE] = rows[i : i + PIECE] @ h[phase][::-1]
    return out


def log_mel(payload: bytes) -> np.ndarray:
    """frames x BANDS of one recording (at least one frame), worked through in pieces of PIECE frames' samples."""
    x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
    y = resample(x)
    # The last frame covers the end.
    y = np.concatenate([y, np.zeros(FRAME + max(0, -(-(len(y) - FRAME) // HOP)) * HOP - len(y), np.float32)])
    window, bank = np.hanning(FRAME).astype(np.float32), mel_bank()
    view = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
    step = max(1, PIECE // FRAME)
    return np.concatenate([np.log(np.maximum((np.abs(np.fft.rfft(view[i : i + step] * window)) ** 2).astype(np.float32) @ bank, np.exp(FLOOR))) for i in range(0, len(view), step)])


def segments(energy: np.ndarray, high: float = HIGH, low: float = LOW) -> np.ndarray:
    """(first, past last) frame of each run that begins above the high threshold and lasts until below the low one."""
    level = (energy - energy.mean()) / max(float(energy.std()), 1e-6)
    # A frame's state is that of the last decisive frame: 1 above high, 0 below low.
    mark = np.where(level > high, 1, np.where(level < low, 0, -1))
    at = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(mark)), -1))
    on = np.where(at >= 0, mark[at], 0) == 1
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
    return edge.reshape(-1, 2)


def tensors(mel: np.ndarray) -> pa.ExtensionArray:
    """mel as an Arrow array of BLOCK x BANDS tensors; frames that are missing in the last one hold FLOOR."""
    blocks = -(-len(mel) // BLOCK)
    full = np.full((blocks * BLOCK, BANDS), FLOOR, np.float32)
    full[: len(mel)] = mel
    return pa.FixedShapeTensorArray.from_numpy_ndarray(full.reshape(blocks, BLOCK, BANDS))


def to_ipc(array: pa.ExtensionArray) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.record_batch([array], names=["log_mel"])
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_ipc(data: bytes) -> np.ndarray:
    """blocks x BLOCK x BANDS of what to_ipc() made."""
    column = pa.ipc.open_stream(data).read_all().column(0)
    return np.concatenate([c.to_numpy_ndarray() for c in column.chunks])


FEATURES = T.StructType([
    T.StructField("media", T.BinaryType()), T.StructField("log_mel", T.BinaryType()), T.StructField("n_frames", T.IntegerType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start_s", T.DoubleType()), T.StructField("end_s", T.DoubleType())]))),
])


def media_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns of FEATURES: the WAV of ``text``, its tensors (Arrow IPC stream), frames and time spans.

    Columns of these names are replaced, all others pass. A null text counts as empty, which is stored as 192 spaces.
    Equal texts give equal values. A narrow step: a task holds one small batch of rows.
    """
    docs = docs.drop(*FEATURES.names)
    names = docs.columns
    seconds = HOP * DOWN / UP / RATE

    def make():
        def step(batch):
            media = [encode(t) for t in batch.column(names.index(text)).to_pylist()]
            mels = [log_mel(samples(m)) for m in media]
            spans = [segments(m.mean(axis=1)) * seconds for m in mels]
            return {n: batch.column(i) for i, n in enumerate(names)} | {"media": media, "log_mel": [to_ipc(tensors(m)) for m in mels], "n_frames": [len(m) for m in mels], "spans": [[{"start_s": float(a), "end_s": float(b)} for a, b in s] for s in spans]}

        return step

    return map_batches(docs, T.StructType([*docs.schema, *FEATURES]), make)


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: what the stored bytes hold, read back from them, and a digest of the features."""
    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    made = media_features(slim).withColumn("payload", F.expr(f"substring(media, {HEADER + 1}, length(media) - {HEADER})"))
    tail = F.expr("substring(payload, length(payload) - 15, 16)")
    spans = F.concat_ws(",", F.transform("spans", lambda s: F.format_string("%.3f-%.3f", s.start_s, s.end_s)))
    feature = F.concat_ws("|", F.concat(F.lit("frames="), F.col("n_frames").cast("string")), F.concat(F.lit("log_mel="), F.md5("log_mel")), F.concat(F.lit("segments="), F.size("spans").cast("string")), F.concat(F.lit("spans="), F.md5(spans)))
    return made.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"))
