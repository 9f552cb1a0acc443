"""Speech spans of endless recordings: the hysteresis machine as keyed state across micro-batches.

Frames of a recording may be cut into micro-batches anywhere, and may come in
any order within and between them: frames that come early wait in the state.  A
span leaves once the next one is known, since the silence between them is
shared, or once the recording ends.  Spans equal those of
:func:`intervals.speech_spans` over all frames.

The state of a recording is a few numbers, and the frames that wait.  It
survives a restart from the query's checkpoint.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.intervals import WINDOW_SAMPLES, Hysteresis

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
Span = tuple[int, int, int]


class SpeechMachine:
    """The speech state machine, a frame at a time; :attr:`held` is all of its state, as plain values."""

    def __init__(self, h: Hysteresis, held: dict[str, Any] | None = None):
        self.h = h
        self.held = held or {"frames": 0, "begin": None, "hush": None, "silence": None, "open": None, "spans": 0, "early": {}, "ended": False}

    def _close(self, start: int, end: int) -> Iterator[Span]:
        """A raw span is known: the one before it can leave."""
        before, start_at = self.held["open"], start - self.h.pad
        if before:
            gap = start - before[1]
            give = gap // 2 if gap < 2 * self.h.pad else self.h.pad
            yield self.held["spans"], before[0], int(before[1] + give)
            self.held["spans"] += 1
            start_at = start - give
        self.held["open"] = [int(max(0, start_at)), end]

    def frame(self, prob: float) -> Iterator[Span]:
        """The spans that leave with the next frame."""
        if not 0 <= prob <= 1:
            raise ValueError("probabilities must be between zero and one")
        s, h = self.held, self.h
        at, loud = s["frames"] * WINDOW_SAMPLES, prob >= h.threshold
        s["frames"] += 1
        if loud and s["hush"] is not None:
            length = at - s["hush"]
            # the first of the longest silences is the place to cut
            if length > h.cut_silence and (s["silence"] is None or length > s["silence"][1]):
                s["silence"] = [s["hush"], length]
            s["hush"] = None
        if s["begin"] is None:
            if loud:
                s["begin"] = at
            return
        if at - s["begin"] > h.max_speech - WINDOW_SAMPLES - 2 * h.pad:
            if s["silence"] is None:
                yield from self._close(s["begin"], at)
                s["begin"] = s["hush"] = None
                return
            where, length = s["silence"]
            yield from self._close(s["begin"], where)
            s["begin"], s["hush"], s["silence"] = where + length, None, None
        if prob < h.exit_below:
            s["hush"] = at if s["hush"] is None else s["hush"]
            if at - s["hush"] >= h.min_silence:
                if s["hush"] - s["begin"] > h.min_speech:
                    yield from self._close(s["begin"], s["hush"])
                s["begin"] = s["hush"] = s["silence"] = None

    def end(self, samples: int) -> Iterator[Span]:
        """The spans that leave with the recording's end."""
        s = self.held
        if -(-samples // WINDOW_SAMPLES) != s["frames"]:
            raise ValueError(f"expected {-(-samples // WINDOW_SAMPLES)} frames, got {s['frames']}")
        if s["begin"] is not None and samples - s["begin"] > self.h.min_speech:
            yield from self._close(s["begin"], samples)
        if s["open"]:
            yield s["spans"], s["open"][0], int(min(samples, s["open"][1] + self.h.pad))
        s |= {"begin": None, "open": None, "ended": True, "early": {}}

    def rows(self, rows: list[tuple[int, float | None, int | None]]) -> Iterator[Span]:
        """The spans that leave with rows ``(frame, prob, samples)`` in any order; one with ``samples`` is the end, after all frames.

        Rows that came before, and any after the end, say nothing new.
        """
        early = self.held["early"]
        for frame, prob, samples in rows:
            if not self.held["ended"] and frame >= self.held["frames"]:
                early.setdefault(str(frame), (prob, samples))
        while (row := early.pop(str(self.held["frames"]), None)) is not None:
            yield from self.end(row[1]) if row[1] is not None else self.frame(row[0])
            early = self.held["early"]


class SpeechProcessor(StatefulProcessor):
    def __init__(self, h: Hysteresis, key: str):
        self.h, self.key = h, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("speech", "held string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        machine = SpeechMachine(self.h, json.loads(self.state.get()[0]) if self.state.exists() else None)
        spans: list[Span] = []
        for pdf in rows:
            whole = lambda x: None if x is None or isinstance(x, float) and math.isnan(x) or x is pd.NA else int(x)
            spans += machine.rows([(int(f), p, whole(n)) for f, p, n in zip(pdf["frame"], pdf["prob"], pdf["samples"], strict=True)])
        self.state.update((json.dumps(machine.held),))
        yield pd.DataFrame([(key[0], *s) for s in spans], columns=[self.key, "span_index", "s", "e"])

    def close(self) -> None:
        pass


def stream_speech(frames: DataFrame, h: Hysteresis, key: str = "job") -> DataFrame:
    """``(key, span_index, s, e)`` of a stream of ``(key, frame, prob, samples)``; the row with ``samples`` ends a recording, its ``frame`` is their number.

    Needs the RocksDB state store, which is set here.
    """
    frames.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    kind = dict(frames.dtypes)[key]
    return frames.select(key, "frame", "prob", "samples").groupBy(key).transformWithStateInPandas(statefulProcessor=SpeechProcessor(h, key), outputStructType=f"{key} {kind}, span_index long, s long, e long", outputMode="Append", timeMode="None")
