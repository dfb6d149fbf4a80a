"""Media columns: audio features of 8-bit samples, as fixed-shape Arrow tensors with time spans.

Samples are resampled by a polyphase filter, cut into overlapped frames for a log-mel filterbank, and segmented by frame
energy with hysteresis.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BLOCK = 576
PAD = 255
RATE = 16_000
#: Resampling by UP / DOWN, TAPS of the filter for each phase.
UP, DOWN, TAPS = 1, 2, 24
FRAME, HOP, BANDS = 256, 128, 32
#: Frames of a tensor: every tensor is CLIP x BANDS, the last one of a clip padded with its floor value.
CLIP = 64
FLOOR = 1e-8
#: A segment begins where a frame's energy is so far above the mean (in standard deviations), and lasts until it is below.
BEGIN, LAST = 0.75, -0.25
_STEP = 8192  # frames at once: bounds memory for very long samples


def wav(samples: bytes, rate: int = RATE) -> bytes:
    """A RIFF file of one channel of unsigned 8-bit samples. An odd number of samples gets the format's pad byte."""
    n = len(samples)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n + n % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n)
    return head + samples + b"\0" * (n % 2)


def read_wav(data: bytes) -> tuple[bytes, int]:
    """(samples, rate) of a file with one channel of 8-bit samples: walks the chunks."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(data):
        kind, n = struct.unpack_from("<4sI", data, at)
        if kind == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            if (code, channels, bits) != (1, 1, 8):
                raise ValueError("not one channel of 8-bit samples")
        elif kind == b"data":
            return data[at + 8 : at + 8 + n], rate
        at += 8 + n + n % 2
    raise ValueError("no samples")


def payload(text: bytes) -> bytes:
    """The text's bytes, filled with PAD up to a positive multiple of BLOCK."""
    return text + bytes([PAD]) * ((-len(text)) % BLOCK or (0 if text else BLOCK))


def _phases(up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """The windowed-sinc low-pass filter, split into its ``up`` phases (up x taps)."""
    n = np.arange(up * taps) - (up * taps - 1) / 2
    cut = 1.0 / max(up, down)
    h = cut * np.sinc(cut * n) * np.hamming(up * taps)
    return (h * up / h.sum()).reshape(taps, up).T.astype(np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """Polyphase resampling by up/down: output k takes phase (k * down) mod up of the filter at input (k * down) // up."""
    n_out = -(-len(x) * up // down)
    phases = _phases(up, down, taps)
    padded = np.concatenate([np.zeros(taps // 2, np.float32), x, np.zeros(taps, np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, taps)
    out = np.empty(n_out, np.float32)
    for r in range(up):  # outputs of one residue share a phase
        k = slice(r, n_out, up)
        first, step = (r * down) // up, down
        phase = phases[(r * down) % up][::-1]
        rows = windows[first :: step][: len(range(r, n_out, up))]
        for i in range(0, len(rows), 1 << 18):
            out[k][i : i + (1 << 18)] = rows[i : i + (1 << 18)] @ phase
    return out


def _mel(rate: float) -> np.ndarray:
    """Triangular filters (bins x bands) evenly spaced on the mel scale."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    hz = 700 * (10 ** (np.linspace(0, top, BANDS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FRAME, 1 / rate)[:, None]
    return np.maximum(0, np.minimum((f - hz[:-2]) / (hz[1:-1] - hz[:-2]), (hz[2:] - f) / (hz[2:] - hz[1:-1]))).astype(np.float32)


_WINDOW = np.hanning(FRAME).astype(np.float32)
_MEL: dict[float, np.ndarray] = {}


def log_mel(x: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """(frames x bands log-mel energies, frames' log energies) of overlapped frames; the last frame is filled with zeros."""
    mel = _MEL.setdefault(rate, _mel(rate))
    n = 1 + max(0, -(-(len(x) - FRAME) // HOP))
    x = np.concatenate([x, np.zeros(max(0, (n - 1) * HOP + FRAME - len(x)), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    bands, energy = np.empty((n, BANDS), np.float32), np.empty(n, np.float32)
    for i in range(0, n, _STEP):
        part = frames[i : i + _STEP] * _WINDOW
        power = np.abs(np.fft.rfft(part, axis=1)).astype(np.float32) ** 2
        bands[i : i + _STEP] = np.log(power @ mel + np.float32(FLOOR))
        energy[i : i + _STEP] = np.log((part * part).sum(axis=1) + np.float32(FLOOR))
    return bands, energy


def segments(energy: np.ndarray, begin: float = BEGIN, last: float = LAST) -> list[tuple[int, int]]:
    """(first, after the last) frame of each segment: hysteresis between two levels around the mean."""
    level = (energy - energy.mean()) / (energy.std() + 1e-6)
    mark = np.where(level >= begin, 1, np.where(level < last, -1, 0))
    at = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = (at >= 0) & (mark[at] == 1)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def features(samples: bytes, rate: int = RATE) -> tuple[np.ndarray, list[tuple[float, float]], list[tuple[float, float]]]:
    """(tensors: clips x CLIP x BANDS, the clips' time spans, the segments' time spans in seconds)."""
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    out_rate = rate * UP / DOWN
    bands, energy = log_mel(resample(x), out_rate)
    clips = -(-len(bands) // CLIP)
    tensor = np.full((clips * CLIP, BANDS), np.log(FLOOR), np.float32)
    tensor[: len(bands)] = bands
    second = HOP / out_rate
    spans = [(i * CLIP * second, min(len(bands), (i + 1) * CLIP) * second) for i in range(clips)]
    return tensor.reshape(clips, CLIP, BANDS), spans, [(a * second, b * second) for a, b in segments(energy)]


def tensor_array(values: np.ndarray) -> pa.FixedShapeTensorArray:
    """clips x CLIP x BANDS as an Arrow array of fixed-shape tensors, with named dimensions."""
    kind = pa.fixed_shape_tensor(pa.float32(), (CLIP, BANDS), dim_names=["frame", "band"])
    return pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(pa.array(values.reshape(-1)), CLIP * BANDS))


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media binary): each text's payload as a WAVE file, written to the shared folder. Null texts are empty."""
    common.small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            raw = common.texts(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in raw], pa.int64()), pa.array([wav(payload(t)) for t in raw], pa.binary())], ["id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return common.stash(rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, media binary"), "media", compression="zstd")


def tensors(media: DataFrame) -> DataFrame:
    """(id, clip, start_s, end_s, log_mel array<float> of CLIP x BANDS values, segments array<struct<start_s, end_s>>) for rows of (id, media).

    A row per clip; a null media value gives none. ``tensor_array`` makes the arrays into Arrow tensors of fixed shape.
    """
    common.small_batches(media.sparkSession, 100)

    def run(batches):
        spans_kind = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
        for b in batches:
            for i, data in enumerate(b.column(1).to_pylist()):
                if data is None:
                    continue
                values, spans, found = features(*read_wav(data))
                n = len(spans)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * CLIP * BANDS), tensor_array(values).storage.flatten())
                marks = [[{"start_s": s, "end_s": e} for s, e in found if s < z and e > a] for a, z in spans]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i] * n)), pa.array(range(n), pa.int32()), pa.array([s for s, _ in spans]), pa.array([e for _, e in spans]), flat, pa.array(marks, spans_kind)], ["id", "clip", "start_s", "end_s", "log_mel", "segments"])

    kind = media.schema["id"].dataType.simpleString()
    return media.select("id", "media").mapInArrow(run, f"id {kind}, clip int, start_s double, end_s double, log_mel array<float>, segments array<struct<start_s:double,end_s:double>>")


def feature_string(values: np.ndarray, spans: list, found: list) -> str:
    """Clips, length in s, mean log-mel of 8 groups of bands, number and total length of segments, and a digest of the tensors to 1/32."""
    mean = values.reshape(-1, 8, BANDS // 8).mean(axis=(0, 2), dtype=np.float64)
    rounded = np.round(values * 32).astype("<i2").tobytes()
    bands = ",".join(f"{x:.2f}" for x in mean)
    return f"clips={len(spans)};seconds={spans[-1][1]:.3f};bands={bands};segments={len(found)};active={sum(b - a for a, b in found):.3f};tensors={hashlib.md5(rounded).hexdigest()}"


def digest(media: DataFrame) -> DataFrame:
    """The query's columns, from the stored media alone: what was read back, and its features. Equal media give equal rows."""
    common.small_batches(media.sparkSession)
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for b in batches:
            seen: dict[bytes, tuple] = {}
            out = []
            for data in b.column(2).to_pylist():
                if data not in seen:
                    samples, rate = read_wav(data)
                    seen[data] = (len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature_string(*features(samples, rate)))
                out.append(seen[data])
            cols = list(zip(*out)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, k) for c, k in zip(cols, [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()])]], names)

    kind = media.schema["id"].dataType.simpleString()
    return media.mapInArrow(run, f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op6_audio(spark, sf_dir: str) -> DataFrame:
    """Null and empty texts are one block of padding; texts count whole; repeated rows give equal rows; an empty table gives none."""
    return digest(store(common.table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")
