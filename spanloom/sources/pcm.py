"""A data source of PCM files: RIFF containers read by byte ranges.

A stretch has ``range_bytes`` at most, and a partition some stretches, up to
``RANGE_BYTES`` (or ``range_bytes``, if that is more) and ``STRETCHES`` together:
small files share one, and a long recording is read by many tasks, each of which
reads the container's chunk headers and then only its own stretches.  Rows are
``(path, rate, channels, bits, first, samples, pcm, error)``: ``first`` is the
stretch's place in sample frames after the start, ``samples`` how many the
whole range has.  With a ``limit`` of seconds the range has one sample frame
more than that, so that a recording over the limit can be told from one at it.

A file that isn't a readable container has one row with its error.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .publish import opened

FORMAT = "spanloom_pcm"
SCHEMA = "path string, rate int, channels int, bits int, first bigint, samples bigint, pcm binary, error string"
RANGE_BYTES = 32 << 20
#: Stretches of a partition: a file costs the same however short it is.
STRETCHES = 1000


class Header(NamedTuple):
    """What a container says of its samples: their place and size in the file, in bytes."""

    rate: int
    channels: int
    bits: int
    begin: int
    size: int

    @property
    def frame(self) -> int:
        return self.channels * self.bits // 8


def header(f, size: int) -> Header:
    """The header of an open file of ``size`` bytes; chunks may come in any order before the samples."""
    if f.read_at(12, 0)[0:4] != b"RIFF" or f.read_at(12, 0)[8:12] != b"WAVE":
        raise ValueError("no RIFF container of samples")
    at, shape = 12, None
    while at + 8 <= size:
        name, length = struct.unpack("<4sI", f.read_at(8, at))
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", f.read_at(16, at + 8))
            if kind not in (1, 0xFFFE) or bits % 8 or not channels or not bits or not rate:
                raise ValueError("samples aren't PCM")
            shape = rate, channels, bits
        elif name == b"data":
            if shape is None:
                raise ValueError("samples come before their format")
            # a stream whose length wasn't known, or that was cut short, goes on to the end of the file
            return Header(*shape, at + 8, min(length, size - at - 8))
        at += 8 + length + length % 2
    raise ValueError("no samples in the container")


@dataclass
class Stretches(InputPartition):
    """(path, size of the file, first byte, end byte) of each stretch; bytes count from the range's start."""

    parts: list[tuple[str, int, int, int]]


class PcmReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.start, self.limit = float(options.get("start", 0)), options.get("limit")
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))
        if self.start < 0 or self.range_bytes <= 0 or self.limit is not None and float(self.limit) < 0:
            raise ValueError("start and limit can't be negative, rangeBytes must be positive")

    def partitions(self) -> list[InputPartition]:
        """Stretches by the files' sizes alone: no file is opened."""
        system, path = opened(self.root)
        info = system.get_file_info(path)
        files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
        out: list[list[tuple[str, int, int, int]]] = [[]]
        most = room = max(RANGE_BYTES, self.range_bytes)
        for f in sorted((f for f in files if f.type == fs.FileType.File and f.extension.lower() in ("wav", "wave")), key=lambda f: f.path):
            for a in range(0, max(1, f.size), self.range_bytes):
                b = min(f.size, a + self.range_bytes)
                if out[-1] and (b - a > room or len(out[-1]) == STRETCHES):
                    out.append([])
                    room = most
                out[-1].append((f.path, f.size, a, b))
                room -= b - a
        return [Stretches(p) for p in out]

    def read(self, partition: Stretches) -> Iterator[tuple]:
        system, _ = opened(self.root)
        # how far the last file is read, by its path
        seen: tuple[str, int] | None = None
        for path, size, a, b in partition.parts:
            if seen and seen[0] == path and a >= seen[1]:
                continue
            try:
                with system.open_input_file(path) as f:
                    h = header(f, size)
                    skip = round(self.start * h.rate)
                    have = max(0, h.size // h.frame - skip)
                    if self.limit is not None:
                        have = min(have, round(float(self.limit) * h.rate) + 1)
                    seen = path, have * h.frame
                    # stretches are whole sample frames
                    first, end = min(have, -(-a // h.frame)), min(have, -(-b // h.frame))
                    if end > first or a == 0:
                        pcm = f.read_at((end - first) * h.frame, h.begin + (skip + first) * h.frame)
                        yield path, h.rate, h.channels, h.bits, first, have, pcm, None
            except (ValueError, OSError, struct.error) as e:
                if a == 0:
                    yield path, None, None, None, None, None, None, f"{type(e).__name__}: {e}"


class PcmSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PcmReader:
        return PcmReader(self.options)


def container(pcm: bytes, rate: int = 16_000, channels: int = 1, bits: int = 16) -> bytes:
    """A RIFF container of samples."""
    frame = channels * bits // 8
    shape = struct.pack("<HHIIHH", 1, channels, rate, rate * frame, frame, bits)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(shape)) + shape + b"data" + struct.pack("<I", len(pcm)) + pcm + b"\0" * (len(pcm) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_pcm(spark: SparkSession, path: str, start: float = 0, limit: float | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The stretches of all files below a path, from ``start`` seconds on and for ``limit`` seconds and a sample frame."""
    spark.dataSource.register(PcmSource)
    reader = spark.read.format(FORMAT).option("start", str(start)).option("rangeBytes", str(range_bytes))
    return (reader if limit is None else reader.option("limit", str(limit))).load(path)
