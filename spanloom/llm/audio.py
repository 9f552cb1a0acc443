"""Media columns: audio features of 8-bit WAV bytes.

Each payload is stored as an unsigned 8-bit mono WAV; the stored bytes are
parsed again before any feature is computed.  The samples are resampled with a
polyphase filter (``UP``/``DOWN``), framed with overlap, and turned into
log-mel energies.  Frame energy drives a hysteresis segmentation: a span opens
at ``open_db`` above the floor and closes after ``hang`` frames below
``close_db``.  Features are kept as one Arrow IPC stream for each row, whose
records hold a fixed-shape tensor of ``TILE`` x ``MELS`` quantised log-mels with
the tile's time span.

Each row's features depend on its own bytes alone.  A task holds the signal of
one row at a time, about 50 bytes for each of its text, and the media of 256.

Defined results: a null or empty text is 192 blanks; repeated rows have equal
media and features.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .texts import others

UNIT = 192
RATE = 12_000
UP, DOWN = 2, 3
FRAME, HOP, FFT = 200, 80, 256
MELS, TILE = 20, 32


@dataclass(frozen=True)
class Levels:
    """Hysteresis thresholds in dB over the row's mean energy, and the frames below before a span closes."""

    open_db: float = 1.0
    close_db: float = -1.0
    hang: int = 3


def payload(text: str | None) -> bytes:
    """UTF-8 with blanks up to a positive multiple of ``UNIT`` bytes."""
    raw = (text or "").encode("utf-8", "replace")
    return raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b" ")


def wav(samples: bytes, rate: int = RATE) -> bytes:
    """An 8-bit mono PCM WAV of the samples."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + len(samples) % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples + b"\0" * (len(samples) % 2)


def read_wav(media: bytes) -> tuple[int, np.ndarray]:
    """Rate and unsigned samples of an 8-bit mono WAV; chunks other than fmt and data are passed over."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM is read")
        elif name == b"data":
            return rate, np.frombuffer(media, np.uint8, size, at + 8)
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def lowpass(up: int = UP, down: int = DOWN, half: int = 8) -> np.ndarray:
    """A Hann-windowed sinc at the narrower Nyquist rate, ``up`` in gain."""
    widest = max(up, down)
    n = np.arange(-half * widest, half * widest + 1)
    return up / widest * np.sinc(n / widest) * np.hanning(len(n) + 2)[1:-1]


TAPS = lowpass()
WINDOW = np.hanning(FRAME)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Polyphase resampling: only the filter phase that each output needs is applied."""
    taps = TAPS if (up, down) == (UP, DOWN) else lowpass(up, down)
    mid = len(taps) // 2
    out = np.empty(-(-len(x) * up // down), np.float64)
    for phase in range(up):
        # outputs k with (k * down) % up == phase share one sub-filter
        k0 = next(k for k in range(up) if k * down % up == phase)
        if k0 >= len(out):
            continue
        sub = taps[::-1][(mid - phase) % up :: up]
        # tap j of sub multiplies x[(k*down - phase)//up + offset + j]
        offset = -((mid - phase - (mid - phase) % up) // up)
        count = len(range(k0, len(out), up))
        starts = (k0 * down - phase) // up + offset
        need = starts + (count - 1) * down + len(sub)
        padded = np.zeros(max(need, len(x)) + max(0, -starts) + len(sub))
        lead = max(0, -starts)
        padded[lead : lead + len(x)] = x
        rows = np.lib.stride_tricks.sliding_window_view(padded, len(sub))[starts + lead :: down][:count]
        out[k0::up] = rows @ sub
    return out


def mel_bank(rate: float, mels: int = MELS, fft: int = FFT) -> np.ndarray:
    """Triangular filters with equal steps in mel, as (bins, mels)."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edge = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    f = np.arange(fft // 2 + 1) * rate / fft
    rise = (f[:, None] - edge[:-2]) / (edge[1:-1] - edge[:-2])
    fall = (edge[2:] - f[:, None]) / (edge[2:] - edge[1:-1])
    return np.clip(np.minimum(rise, fall), 0, None)


def log_mels(x: np.ndarray, bank: np.ndarray, block: int = 64 * TILE) -> np.ndarray:
    """Log-mel energies in dB, one row for each hop; the last frames are padded with zeros."""
    frames = max(1, -(-len(x) // HOP))
    padded = np.zeros((frames - 1) * HOP + FRAME)
    padded[: len(x)] = x[: len(padded)]
    view = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    out = np.empty((frames, bank.shape[1]))
    for k in range(0, frames, block):
        spectrum = np.fft.rfft(view[k : k + block] * WINDOW, FFT, axis=1)
        out[k : k + block] = 10 * np.log10((spectrum.real**2 + spectrum.imag**2) @ bank + 1e-6)
    return out


def energy_spans(level: np.ndarray, levels: Levels = Levels()) -> list[tuple[int, int]]:
    """Half-open frame spans: opened at ``open_db``, closed by ``hang`` frames under ``close_db``; the quiet frames are cut off."""
    if not len(level):
        return []
    high, low = np.flatnonzero(level >= levels.open_db), level < levels.close_db
    run = np.convolve(low, np.ones(levels.hang, int))[: len(low)] == levels.hang
    shut = np.flatnonzero(run)
    spans, at = [], 0
    while True:
        i = np.searchsorted(high, at)
        if i == len(high):
            return spans
        start = int(high[i])
        j = np.searchsorted(shut, start + levels.hang)
        end = int(shut[j]) + 1 - levels.hang if j < len(shut) else len(level)
        spans.append((start, end))
        if j == len(shut):
            return spans
        at = int(shut[j]) + 1


class Extractor:
    """The filters of a rate, made once for a task."""

    def __init__(self, levels: Levels = Levels()):
        self.levels, self.banks = levels, {}
        self.kind = pa.fixed_shape_tensor(pa.int16(), (TILE, MELS))
        self.schema = pa.schema([("mel", self.kind), ("start_s", pa.float64()), ("end_s", pa.float64())])

    def __call__(self, media: bytes) -> tuple[bytes, list[tuple[float, float]], int]:
        """(Arrow IPC stream of tensors with time spans, energy spans in seconds, frames)."""
        rate, samples = read_wav(media)
        out_rate = rate * UP / DOWN
        if rate not in self.banks:
            self.banks[rate] = mel_bank(out_rate)
        bank = self.banks[rate]
        mel = log_mels(resample(samples.astype(np.float64) / 128 - 1), bank)
        # tenths of a dB: far coarser than any difference in how a CPU sums
        tenths = np.rint(mel * 10).astype(np.int16)
        frames = len(tenths)
        tiles = -(-frames // TILE)
        whole = np.zeros((tiles * TILE, MELS), np.int16)
        whole[:frames] = tenths
        step = HOP / out_rate
        starts = np.arange(tiles) * TILE * step
        ends = np.minimum(starts + TILE * step, frames * step)
        flat = pa.FixedSizeListArray.from_arrays(pa.array(whole.ravel()), TILE * MELS)
        tensor = pa.ExtensionArray.from_storage(self.kind, flat)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.schema) as writer:
            writer.write_batch(pa.record_batch([tensor, pa.array(starts), pa.array(ends)], schema=self.schema))
        level = tenths.mean(1) / 10
        spans = energy_spans(np.round(level - np.round(level.mean(), 3), 3), self.levels)
        return sink.getvalue().to_pybytes(), [(round(a * step, 6), round(b * step, 6)) for a, b in spans], frames


SPANS = T.ArrayType(T.StructType([T.StructField("start_s", T.DoubleType()), T.StructField("end_s", T.DoubleType())]))


def audio_columns(df: DataFrame, text_col: str = "text", levels: Levels = Levels()) -> DataFrame:
    """``df`` with ``media`` (WAV bytes), ``tensors`` (Arrow IPC stream), ``spans`` (seconds) and ``frames`` in place of the text.

    Columns of those names in ``df`` are replaced.
    """
    names = ["media", "tensors", "spans", "frames"]
    keep = others(df, *names, text_col)
    kind = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract = Extractor(levels)
        for batch in batches:
            # a few rows at a time: media and tensors are larger than texts
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                media = [wav(payload(t)) for t in part.column(part.num_columns - 1).to_pylist()]
                found = [extract(m) for m in media]
                spans = pa.array([[{"start_s": a, "end_s": b} for a, b in s] for _, s, _ in found], kind)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(media, pa.binary()), pa.array([t for t, _, _ in found], pa.binary()), spans, pa.array([n for _, _, n in found], pa.int64())], names=[*keep, *names]
                )

    fields = [df.schema[c] for c in keep]
    schema = T.StructType([*fields, T.StructField("media", T.BinaryType()), T.StructField("tensors", T.BinaryType()), T.StructField("spans", SPANS), T.StructField("frames", T.LongType())])
    return df.select(*keep, F.col(text_col).cast("string").alias("\x00text")).mapInArrow(run, schema)


def wav_payload(media: Column) -> Column:
    """The data bytes of a WAV column written by :func:`wav`, by the size that its header gives."""
    size = F.conv(F.concat(*(F.hex(F.substring(media, k, 1)) for k in (44, 43, 42, 41))), 16, 10).cast("int")
    return media.substr(F.lit(45), size)
