"""Discovery of recordings: suffixes, first-wins dedup, output paths and collisions."""

from __future__ import annotations

import os
from collections.abc import Iterable, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The suffixes of audio files.
AUDIO_SUFFIXES = (".aac", ".aif", ".aiff", ".alac", ".flac", ".m4a", ".mp3", ".mp4", ".oga", ".ogg", ".opus", ".wav", ".wave", ".webm", ".wma")


class InputError(ValueError):
    """An input that can't be used."""


def expand_inputs(inputs: str | os.PathLike | Sequence[str | os.PathLike], recursive: bool = False) -> list[tuple[str, str]]:
    """(canonical path, relative path) of local recordings, in order; the first name of a file stays.

    A file counts whatever its suffix; a folder gives its audio files, ordered
    by case-folded path.
    """
    several = [inputs] if isinstance(inputs, (str, os.PathLike)) else list(inputs)
    if not several or any(isinstance(p, bytes) or not isinstance(p, (str, os.PathLike)) or not str(p) for p in several):
        raise InputError("inputs must be one path or a sequence of paths")
    found: dict[str, str] = {}
    for given in several:
        path = Path(given).expanduser()
        try:
            whole = path.resolve(strict=True)
        except (OSError, RuntimeError) as e:
            raise InputError(f"cannot resolve {given}: {e}") from e
        if whole.is_file():
            found.setdefault(str(whole), path.name)
        elif whole.is_dir():
            inner: Iterable[Path] = whole.rglob("*") if recursive else whole.iterdir()
            audio = [p for p in inner if p.is_file() and p.suffix.lower() in AUDIO_SUFFIXES]
            if not audio:
                raise InputError(f"no audio in {given}")
            for p in sorted(audio, key=lambda p: str(p).casefold()):
                found.setdefault(str(p.resolve()), str(p.relative_to(whole)))
        else:
            raise InputError(f"not a file or folder: {given}")
    return list(found.items())


def recordings(spark: SparkSession, folder: str, recursive: bool = True, max_bytes: int | None = None) -> DataFrame:
    """``(path, modified, length)`` of the audio files under a folder on any store; contents and hidden files are not read, and a size limit reaches the scan."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    kept = files.filter(is_audio(F.col("path")))
    if max_bytes is not None:
        kept = kept.filter(F.col("length") <= max_bytes)
    return kept.select("path", F.col("modificationTime").alias("modified"), "length")


def suffix(path: Column) -> Column:
    """The lower-cased suffix of a path's last part, with its dot; empty without one."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def is_audio(path: Column) -> Column:
    return suffix(path).isin(*AUDIO_SUFFIXES)


def first_of(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def output_path(root: Column, relative: Column, form: str) -> Column:
    """``root/parent/stem.form`` of a relative path."""
    stem = F.regexp_replace(relative, r"(?<=[^/])\.[^./]+$", "")
    return F.concat(root, F.lit("/"), stem, F.lit(f".{form}"))


def collisions(jobs: DataFrame, output: str, source: str, reserved: DataFrame | None = None) -> DataFrame:
    """``(output, claims, fault)``: outputs claimed by several inputs, that are inputs themselves, or that are reserved (``reserved.output``)."""
    claims = jobs.groupBy(F.col(output).alias("output")).agg(F.count("*").alias("claims"))
    held = claims.join(jobs.select(F.col(source).alias("output"), F.lit(True).alias("_in")).distinct(), "output", "left")
    fault = F.when(F.col("claims") > 1, "claimed twice").when(F.col("_in"), "is an input")
    if reserved is not None:
        held = held.join(reserved.select("output", F.lit(True).alias("_res")).distinct(), "output", "left")
        fault = F.when(F.col("claims") > 1, "claimed twice").when(F.col("_in"), "is an input").when(F.col("_res"), "is reserved")
    return held.select("output", "claims", fault.alias("fault")).filter("fault is not null")
