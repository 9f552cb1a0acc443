"""The model boundary: recognisers run in ``mapInPandas``, with failures kept to their rows."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.worker import once
from .packing import oom_split


class Recognizer(Protocol):
    """Texts of a batch of items; raises ``MemoryError`` for too large a batch, and other errors for items it can't read."""

    def __call__(self, items: list[Any]) -> list[str]: ...


class StubRecognizer:
    """A deterministic stand-in: words from the hash of an item."""

    def __call__(self, items: list[Any]) -> list[str]:
        return [" ".join(f"w{b}" for b in hashlib.sha256(str(x).encode()).digest()[:4]) for x in items]


class EngineUnavailable(RuntimeError):
    """An engine that can't be loaded here; another may be."""


def first_available(engines: dict[str, Callable[[], Any]], requested: str = "auto") -> tuple[str, Any, str | None]:
    """``(name, engine, reason)``: the engine asked for, or with ``auto`` the first that loads and why those before it didn't.

    Only :class:`EngineUnavailable` passes on to the next engine; the last one's is raised, with the reasons before it.
    """
    if requested != "auto":
        return requested, engines[requested](), None
    reasons: list[str] = []
    for name, make in engines.items():
        try:
            return name, make(), "; ".join(reasons) or None
        except EngineUnavailable as e:
            reasons.append(f"{name}: {e}")
    raise EngineUnavailable("; ".join(reasons) or "no engine is given")


def isolated(run: Callable[[list[Any]], list[str]], items: list[Any], cap: int | None = None, log: list[int] | None = None, sizes: list[float] | None = None, state: dict[str, Any] | None = None, calls: list[dict[str, Any]] | None = None) -> list[tuple[str | None, str | None]]:
    """(text, error) of each item: a batch that fails is cut in two until the bad item is alone.

    Memory failures halve the cap, and with ``sizes``, longest first, cut the
    batch where its parts cost most alike.  A ``SystemError`` means the device is
    lost: items not done yet fail with it.  ``state`` is a dict that keeps both
    from one call to the next.  ``calls`` gets a dict for each batch that
    succeeds: ``at`` and ``end`` of its items, its ``seconds``, and ``failures``,
    the batches that failed for memory since the one before it.
    """
    out: list[tuple[str | None, str | None]] = [(None, None)] * len(items)
    state = {} if state is None else state
    state.setdefault("lost", None)
    most = max(1, cap or len(items))
    failures = 0

    def part(a: int, b: int) -> None:
        nonlocal failures
        at = a
        while at < b:
            end = min(b, at + min(most, state.get("cap", most)))
            if state["lost"]:
                out[at:end] = [(None, state["lost"])] * (end - at)
                at = end
                continue
            if log is not None:
                log.append(end - at)
            began = time.perf_counter()
            try:
                out[at:end] = [(t, None) for t in run(items[at:end])]
                if calls is not None:
                    calls.append({"at": at, "end": end, "seconds": time.perf_counter() - began, "failures": failures})
                failures = 0
            except SystemError as e:
                state["lost"] = f"SystemError: {e}"
                continue
            except MemoryError as e:
                failures += 1
                if end - at == 1:
                    out[at] = (None, f"MemoryError: {e}")
                else:
                    state["cap"] = max(1, min(state.get("cap", most), (end - at) // 2))
                    if sizes is None:
                        continue
                    middle = at + oom_split(sizes[at:end])
                    part(at, middle)
                    part(middle, end)
            except Exception as e:  # noqa: BLE001 - any failure belongs to its items
                if end - at == 1:
                    out[at] = (None, f"{type(e).__name__}: {e}")
                else:
                    middle = at + (end - at) // 2
                    part(at, middle)
                    part(middle, end)
            at = end

    part(0, len(items))
    return out


#: What a batch that succeeded says of itself, in the row of its first item.
BATCH = "struct<rows:long,valid:long,padded:long,failures:long,seconds:double>"


def recognize(df: DataFrame, column: str, make: Callable[[], Recognizer], name: str = "recognizer", batch: int = 24, frames: str | None = None) -> DataFrame:
    """``df`` with ``transcript`` and ``error``; a worker makes its recogniser once and keeps it.  Null items are left out and have neither.

    With ``frames``, the column of an item's length, also ``batch``: its rows, their
    frames, the frames when padded to the longest, the batches that failed for memory
    before it and its seconds, in the row of the first item of each batch that succeeded.
    """
    schema = ", ".join(f"{c} {t}" for c, t in df.dtypes) + ", transcript string, error string" + (f", batch {BATCH}" if frames else "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict[str, Any] = {}  # a lost device stays lost for the task
        for pdf in batches:
            got: list[tuple[str | None, str | None]] = [(None, None)] * len(pdf)
            told: list[dict[str, Any] | None] = [None] * len(pdf)
            there = np.flatnonzero(pdf[column].notna())
            for k in range(0, len(there), batch):
                # made at the first item: a run with nothing to recognise loads no model
                calls: list[dict[str, Any]] = []
                rows = there[k : k + batch]
                for at, one in zip(rows, isolated(once(f"model_{name}", make), pdf[column].iloc[rows].tolist(), state=state, calls=calls), strict=True):
                    got[at] = one
                for c in calls if frames else ():
                    sizes = pdf[frames].iloc[rows[c["at"] : c["end"]]].fillna(0).astype("int64")
                    told[rows[c["at"]]] = {"rows": len(sizes), "valid": int(sizes.sum()), "padded": len(sizes) * int(sizes.max()), "failures": c["failures"], "seconds": c["seconds"]}
            out = pdf.assign(transcript=[t for t, _ in got], error=[e for _, e in got])
            yield out.assign(batch=told) if frames else out

    return df.mapInPandas(run, schema)


def next_limit(current: int, ceiling: int) -> int:
    """128 tokens more or twice as many, or the ceiling if that leaves less than 128."""
    proposed = min(ceiling, max(current + 128, 2 * current))
    return ceiling if ceiling - proposed < 128 else proposed


def with_retries(run: Callable[[list[Any], int], list[tuple[str, int, bool]]], items: list[Any], first: int, ceiling: int, policy: str = "retry", state: dict[str, Any] | None = None) -> list[dict[str, Any]]:
    """``text, tokens, retried, limited`` of each item; only truncated ones run again, with larger limits up to the ceiling.

    ``run(items, limit)`` gives (text, tokens, truncated) of each.  Memory
    failures of retries halve a cap of their own, kept in ``state``: longer
    limits need smaller batches, while first runs go on as they are.  A first
    run's failure, and that of one item alone, is the caller's.
    """
    state = {} if state is None else state

    def again_in_parts(these: list[Any], limit: int) -> list[tuple[str, int, bool]]:
        done: list[tuple[str, int, bool]] = []
        while len(done) < len(these):
            part = these[len(done) : len(done) + state.get("retry_cap", len(these))]
            try:
                done += run(part, limit)
            except MemoryError:
                if len(part) == 1:
                    raise
                state["retry_cap"] = max(1, min(state.get("retry_cap", len(part)), len(part) // 2))
        return done

    out: list[dict[str, Any]] = [{"retried": False, "limited": False} for _ in items]
    todo, limit = list(range(len(items))), first
    while todo:
        again = []
        for k, (text, tokens, truncated) in zip(todo, (run if limit == first else again_in_parts)([items[k] for k in todo], limit), strict=True):
            out[k] |= {"text": text, "tokens": max(tokens, out[k].get("tokens", 0))}
            if truncated:
                again.append(k)
        grown = next_limit(limit, ceiling)
        if policy != "retry" or grown <= limit:
            for k in again:
                out[k]["limited"] = True
            return out
        for k in again:
            out[k]["retried"] = True
        todo, limit = again, grown
    return out
