"""Subtitle cues: a greedy fold over all words of a recording, then exact rendering."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .folds import fold_groups

#: The signs that end a sentence.
ENDINGS = (".", "!", "?", "؟", "،", "؛", "…")


@dataclass(frozen=True)
class CueLimits:
    """A cue is closed before a word that would break a limit; all three comparisons are strict."""

    chars: int = 80
    seconds: float = 6.0
    gap: float = 0.6
    shortest: float = 0.30


def fold_cues(words: Iterable[tuple[float, float, str]], limits: CueLimits) -> list[tuple[float, float, str]]:
    """(start, end, text) of the cues of one recording's (start, end, text) words in order."""
    out: list[tuple[float, float, str]] = []
    held: list[tuple[float, float, str]] = []
    length = 0

    def close() -> None:
        nonlocal length
        if held:
            first = held[0][0]
            out.append((max(0.0, first), max(first, held[-1][1]), " ".join(w[2] for w in held)))
            held.clear()
            length = 0

    for start, end, text in words:
        if held and (length + 1 + len(text) > limits.chars or end - held[0][0] > limits.seconds or start - held[-1][1] > limits.gap):
            close()
        length += len(text) + (1 if held else 0)
        held.append((start, end, text))
        if text.endswith(ENDINGS):
            close()
    close()
    return out


def build_cues(words: DataFrame, limits: CueLimits, key: str = "job", order: tuple[str, ...] = ("segment_index", "word_index"), start: str = "word_start", end: str = "word_end", text: str = "word") -> DataFrame:
    """``(key, cue_index, start, end, text)``: cues cross segments; one exchange on the key."""

    fold = lambda s, e, w: [(k, *cue) for k, cue in enumerate(fold_cues(zip(s, e, w, strict=True), limits))]
    return fold_groups(words, key, list(order), [start, end, text], fold, [("cue_index", T.LongType()), ("start", T.DoubleType()), ("end", T.DoubleType()), ("text", T.StringType())])


def extend_cues(cues: DataFrame, media: Column, limits: CueLimits, key: str = "job") -> DataFrame:
    """Clamp cues to the media, then let short ones last ``shortest`` seconds, up to the next cue's own start or the media's end."""
    w = Window.partitionBy(key).orderBy("cue_index")
    stop = F.least(F.coalesce(F.lead("start").over(w), media), media)
    start, end = F.least("start", media), F.least("end", media)
    longer = F.when(end - start < limits.shortest, F.greatest(end, F.least(start + limits.shortest, stop))).otherwise(end)
    return cues.withColumn("_e", longer).withColumn("start", start).withColumn("end", F.col("_e")).drop("_e")


def timestamp(seconds: Column, mark: str, hours: bool) -> Column:
    """``HH:MM:SS`` with milliseconds rounded half to even; without the hours where they are zero, unless ``hours``."""
    ms = F.rint(F.greatest(F.lit(0.0), seconds) * 1000).cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    h, m, s = F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60
    tail = F.concat(two(m), F.lit(":"), two(s), F.lit(mark), F.lpad((ms % 1000).cast("string"), 3, "0"))
    full = F.concat(F.when(h < 100, two(h)).otherwise(h.cast("string")), F.lit(":"), tail)
    return full if hours else F.when(h > 0, full).otherwise(tail)


def srt(cues: DataFrame, key: str = "job") -> DataFrame:
    """``(key, srt)``: numbered blocks from 1."""
    block = F.concat((F.col("cue_index") + 1).cast("string"), F.lit("\n"), timestamp(F.col("start"), ",", True), F.lit(" --> "), timestamp(F.col("end"), ",", True), F.lit("\n"), F.col("text"), F.lit("\n\n"))
    return _joined(cues, block, key, "srt", "")


def vtt(cues: DataFrame, key: str = "job") -> DataFrame:
    """``(key, vtt)``: a header, then blocks."""
    block = F.concat(timestamp(F.col("start"), ".", False), F.lit(" --> "), timestamp(F.col("end"), ".", False), F.lit("\n"), F.col("text"), F.lit("\n\n"))
    return _joined(cues, block, key, "vtt", "WEBVTT\n\n")


def _joined(cues: DataFrame, block: Column, key: str, name: str, head: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("cue_index", block.alias("b"))))
    return cues.groupBy(key).agg(F.concat(F.lit(head), F.array_join(F.transform(ordered, lambda x: x["b"]), "")).alias(name))


def plain_text(lines: Column) -> Column:
    """Trimmed non-blank lines, each ended by a newline; a newline alone for none."""
    kept = F.filter(F.transform(lines, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    return F.concat(F.array_join(kept, "\n"), F.lit("\n"))


def short_duration(seconds: Column) -> Column:
    """``1h02m03s``, ``2m03s`` or ``3s``, of seconds rounded half to even."""
    whole = F.rint(F.greatest(F.lit(0.0), seconds)).cast("long")
    h, m, s = F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60
    return F.when(h > 0, F.format_string("%dh%02dm%02ds", h, m, s)).when(m > 0, F.format_string("%dm%02ds", m, s)).otherwise(F.format_string("%ds", s))
