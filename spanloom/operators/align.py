"""CTC forced alignment: the best path of a token sequence through frame scores."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import context_windows

Run = tuple[int, int, int]
Word = tuple[str, float, float, str]
#: Scores (frames x labels, the star last) of a text's stretch of sound.
Scores = Callable[[str, float, float], np.ndarray]


#: Cells of one frame that a group of paths may have, and of all its frames.
ROW_CELLS, GROUP_CELLS = 1 << 12, 1 << 24
#: States that a band may have at a frame, cells of a group of bands, and frames after which a band is cut where it can be.
BAND, BAND_CELLS, CUT = 64, 1 << 20, 32


def best_path(scores: np.ndarray, targets: list[int], blank: int = 0) -> np.ndarray:
    """The label of each frame on the best path that spells ``targets`` with blanks between."""
    if not targets:
        raise ValueError("no targets")
    if blank in targets or max(targets) >= scores.shape[1] or min(targets) < 0:
        raise ValueError("targets must be labels other than the blank")
    path = best_paths([(scores, targets)], blank)[0]
    if path is None:
        raise ValueError("too few frames for the targets")
    return path


def best_paths(items: list[tuple[np.ndarray, list[int]]], blank: int = 0) -> list[np.ndarray | None]:
    """:func:`best_path` of each (scores, targets), many at once; null where the frames are too few.

    Each is looked for in a band of states first, whose bounds suppose how little
    the best path loses.  If the path found loses no more than that, it is the best
    of all; else the band of what it loses has the best.  Where a band is wide,
    or has no path, every state is looked at, for those of about one size at once.
    So clear speech takes work in proportion to its frames, and other speech to
    the frames times the targets.
    """
    out: list[np.ndarray | None] = [None] * len(items)
    todo = [k for k, (s, t) in enumerate(items) if len(t) <= len(s)]
    bands = {k: _band(*items[k], blank) for k in todo}
    whole = [k for k in todo if bands[k] is None]
    while narrow := {k: x for k, x in bands.items() if x is not None}:
        bands = {}
        for group in _alike(narrow):
            for k, (path, lost) in zip(group, _banded([items[k] for k in group], [narrow[k] for k in group], blank), strict=True):
                if path is not None and lost <= narrow[k].holds:
                    out[k] = path
                    continue
                bands[k] = None if path is None else _band(*items[k], blank, lost)
                if bands[k] is None:
                    whole.append(k)
    group: list[int] = []

    def solve() -> None:
        for k, path in zip(group, _path_group([items[k] for k in group], blank), strict=True):
            out[k] = path

    frames = most = 0
    for k in sorted(whole, key=lambda k: (len(items[k][0]), len(items[k][1]))):
        scores, targets = items[k]
        frames, most = max(frames, len(scores)), max(most, len(targets) + 1)
        row = (len(group) + 1) * most
        if group and (row > ROW_CELLS or row * frames > GROUP_CELLS or scores.shape[1] != items[group[0]][0].shape[1]):
            solve()
            group, frames, most = [], len(scores), len(targets) + 1
        group.append(k)
    if group:
        solve()
    return out


class _Band(NamedTuple):
    """The first and last state of each frame, and what its best label scores; all paths that lose up to ``holds`` are within, and lose up to ``room`` at a frame."""

    low: np.ndarray
    high: np.ndarray
    best: np.ndarray
    holds: float
    room: float

    @property
    def width(self) -> int:
        return int((self.high - self.low).max()) + 1


def _band(scores: np.ndarray, targets: list[int], blank: int, lost: float | None = None) -> _Band | None:
    """The states of all paths that score at most ``lost`` less than the best labels of all frames would; null if they are many, or none.

    State 2 i is the blank before target i, and 2 i + 1 the target.  What a path
    loses is the sum over its frames, so each of its labels is among those that
    lose no more than ``lost`` at their frame.  Spelling the targets with these as
    early, and as late, as can be bounds the frames of each.  If not given, ``lost``
    is twice what the targets lose at their best frames.
    """
    label = np.array(targets, np.intp)
    some = np.zeros(scores.shape[1], bool)
    some[label] = some[blank] = True
    used, place = np.flatnonzero(some), np.cumsum(some) - 1
    spoken, quiet = place[label], place[blank]
    part = np.asarray(scores.T[used], np.float64)
    best = part.max(0)
    if not np.isfinite(best).all():
        return None
    missed = best - part
    if lost is None:
        lost = 2 * missed.min(1)[spoken].sum()
    # more than rounding can make of a sum over the frames
    spare = 1e-9 * (1 + np.abs(best).sum() + lost)
    can = [x.tobytes() for x in missed <= lost + spare]
    # equal labels have a blank between
    spelt = np.insert(spoken, 1 + np.flatnonzero(spoken[1:] == spoken[:-1]), quiet)
    order = spelt.tolist()
    at = -1
    first = np.array([at := can[x].find(1, at + 1) for x in order])
    if first.min() < 0:
        return None
    at = len(scores)
    last = np.array([at := can[x].rfind(1, 0, at) for x in reversed(order)])[::-1]
    first, last = first[spelt != quiet], last[spelt != quiet]
    frames = np.arange(len(scores))
    band = _Band(2 * np.searchsorted(last, frames), 2 * np.searchsorted(first, frames, "right"), best, float(lost + spare / 2), float(lost + spare))
    return band if band.width <= BAND else None


def _alike(bands: dict[int, _Band]) -> Iterator[list[int]]:
    """Groups of bands of about one width."""
    group: list[int] = []
    frames = 0
    for k in sorted(bands, key=lambda k: bands[k].width):
        frames += len(bands[k].low)
        if group and frames * bands[k].width > BAND_CELLS:
            yield group
            group, frames = [], len(bands[k].low)
        group.append(k)
    if group:
        yield group


def _banded(items: list[tuple[np.ndarray, list[int]]], bands: list[_Band], blank: int) -> list[tuple[np.ndarray | None, float]]:
    """The best path of each item within its band, by the rules of :func:`_path_group`, and what it loses.

    Where a frame leaves one state, all paths of the band meet, so a band is cut
    there, and its pieces are solved side by side, a column for each.
    """
    width, lengths, sizes = max(x.width for x in bands), np.array([len(s) for s, _ in items]), np.array([len(t) for _, t in items])
    offsets, bases = np.cumsum([0, *lengths]), np.cumsum([0, *(2 * sizes + width + 1)])
    label, over = np.full(bases[-1], blank), np.full(bases[-1], -np.inf)
    for (_, t), x, n in zip(items, bases.tolist(), sizes.tolist(), strict=False):
        label[x + 1 : x + 2 * n : 2] = t = np.array(t, np.intp)
        # the blank between two labels can be passed over, unless they are equal
        over[x + 3 : x + 2 * n : 2][t[1:] != t[:-1]] = 0.0
    # the frames of all items in a row
    of = np.repeat(np.arange(len(items)), lengths)
    low, high = np.concatenate([x.low for x in bands]), np.concatenate([x.high for x in bands])
    row, base = np.arange(width)[:, None], bases[of]
    at = low + base + row
    said, hop, gain = label[at], over[at], np.empty(at.shape)
    for (s, _), x, n in zip(items, offsets.tolist(), lengths.tolist(), strict=False):
        gain[:, x : x + n] = s[np.arange(n), said[:, x : x + n]]
    possible = (gain >= np.concatenate([x.best - x.room for x in bands])) & (row <= high - low)
    only = np.flatnonzero(possible.sum(0) == 1)
    stretch = (only - offsets[of[only]]) // CUT + of[only] * (lengths.max() // CUT + 1)
    only = only[np.diff(stretch, prepend=-1) > 0]
    # pieces from each item's first frame, in any state, and from each cut, in its one state, up to the next
    begin = np.concatenate([offsets[:-1], only])
    order = np.argsort(begin, kind="stable")
    begin, start = begin[order], np.concatenate([np.full(len(items), -1), low[only] + possible[:, only].argmax(0)])[order]
    item, stop, end = of[begin], np.append(start[1:], -1), np.append(begin[1:], -1)
    end = np.where(stop < 0, offsets[item + 1] - 1, end)
    # the longest first, and how many go on for so many frames
    begin, end, start, stop, item = np.stack([begin, end, start, stop, item])[:, np.argsort(begin - end, kind="stable")]
    steps = int(end[0] - begin[0]) + 1
    left = np.searchsorted(begin - end, -np.arange(steps + 1), "right")
    count = len(begin)
    column, rows = np.arange(count), np.arange(width + 2)[:, None] * count
    # two states before the band, the band, and one behind it
    states = np.full((width + 3, count), -np.inf)
    held, flat = states[2:-1], states.reshape(-1)
    whole, cut = np.flatnonzero(start < 0), np.flatnonzero(start >= 0)
    held[:2, whole] = gain[:2, begin[whole]]
    # the piece before has scored this frame
    held[start[cut] - low[begin[cut]], cut] = 0.0
    free, target = stop < 0, np.where(stop < 0, 2 * sizes[item], stop)
    at, total, moves = target.copy(), np.empty(count), [np.empty(0, np.int8)]
    for t in range(steps):
        if t:
            m = left[t]
            now = begin[:m] + t
            seen = flat.take(rows + ((low[now] - low[now - 1]) * count + column[:m]), mode="clip")
            stay, step = seen[2:], seen[1:-1]
            move = (step > stay).view(np.int8)
            best = np.maximum(step, stay)
            over = seen[:-2] + hop.take(now, axis=1)
            np.copyto(move, 2, where=over > best)
            moves.append(move)
            np.add(np.maximum(best, over), gain.take(now, axis=1), out=held[:, :m])
        done = slice(left[t + 1], left[t])
        place = target[done] - low[end[done]] + 2
        silent, spoken = states[place, column[done]], states[place - 1, column[done]]
        total[done] = np.where(free[done], np.maximum(silent, spoken), silent)
        at[done] -= free[done] & (silent < spoken)
    path = np.empty(offsets[-1], np.intp)
    for t in range(steps - 1, -1, -1):
        m = left[t]
        now = begin[:m] + t
        path[now] = at[:m]
        if t:
            at[:m] -= moves[t].reshape(-1).take((at[:m] - low[now]) * m + column[:m], mode="clip")
    paths = np.split(label[path + base], offsets[1:-1])
    return [(x if np.isfinite(score) else None, float(band.best.sum()) - score) for x, score, band in zip(paths, np.bincount(item, total, len(items)).tolist(), bands, strict=True)]


def _path_group(items: list[tuple[np.ndarray, list[int]]], blank: int) -> list[np.ndarray | None]:
    """Best paths frame by frame, a column for each item, with the blanks apart from the targets.

    Row i is the blank before target i, and target i - 1.  On a tie a path
    stays, else takes one step, else passes over the blank.  Only rows that a
    frame can reach, and that can reach the end from there, are looked at.
    """
    count = len(items)
    lengths, sizes = [len(s) for s, _ in items], [len(t) for _, t in items]
    frames, most, columns = max(lengths), max(sizes), items[0][0].shape[1]
    scores = np.zeros((frames, columns, count))
    at = np.zeros((most, count), np.intp)
    # a blank between two labels can be passed over, unless they are equal
    skip = np.full((most, count), -np.inf)
    for k, (s, t) in enumerate(items):
        t = np.array(t, np.intp)
        scores[: len(s), :, k] = s
        at[: len(t), k] = t
        skip[1 : len(t), k][t[1:] != t[:-1]] = 0.0
    at = at * count + np.arange(count)
    quiet, spoken = np.full((most + 1, count), -np.inf), np.full((most + 1, count), -np.inf)
    quiet[0], spoken[1] = scores[0, blank], scores[0].ravel()[at[0]]
    shut, one, two = (np.zeros((frames, most + 1, count), bool) for _ in range(3))
    best, over, seen = (np.empty((most, count)) for _ in range(3))
    ends: list[tuple[float, float]] = [(-np.inf, -np.inf)] * count
    last: dict[int, list[int]] = {}
    for k, n in enumerate(lengths):
        last.setdefault(n - 1, []).append(k)
    spare = min(n - f for n, f in zip(sizes, lengths, strict=True))
    for t in range(frames):
        if t:
            lo, hi = max(0, spare + t), min(most, t + 1)
            n = hi - lo
            q, p, s = quiet[lo:hi], spoken[lo:hi], spoken[lo + 1 : hi + 1]
            np.greater(q, s, out=one[t, lo:hi])
            np.maximum(s, q, out=best[:n])
            np.add(p, skip[lo:hi], out=over[:n])
            np.greater(over[:n], best[:n], out=two[t, lo:hi])
            np.maximum(best[:n], over[:n], out=best[:n])
            q, p = quiet[lo : hi + 1], spoken[lo : hi + 1]
            np.greater(p, q, out=shut[t, lo : hi + 1])
            np.maximum(q, p, out=q)
            q += scores[t, blank]
            np.take(scores[t].ravel(), at[lo:hi], out=seen[:n], mode="clip")
            np.add(best[:n], seen[:n], out=s)
        for k in last.get(t, ()):
            ends[k] = quiet[sizes[k], k], spoken[sizes[k], k]
    out: list[np.ndarray | None] = []
    for k, (_, targets) in enumerate(items):
        if not np.isfinite(max(ends[k])):
            out.append(None)
            continue
        i, silent, path = sizes[k], bool(ends[k][0] >= ends[k][1]), np.empty(lengths[k], np.int64)
        for t in range(lengths[k] - 1, -1, -1):
            if silent:
                path[t] = blank
                silent = not shut.item(t, i, k)
            else:
                path[t] = targets[i - 1]
                if two.item(t, i - 1, k):
                    i -= 1
                elif one.item(t, i - 1, k):
                    i, silent = i - 1, True
        out.append(path)
    return out


def runs(path: np.ndarray) -> list[Run]:
    """(label, first, last) of each maximal run."""
    return list(zip(*(x.tolist() for x in _runs(path)), strict=True))


def _runs(path: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cut = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]]))
    return path[cut], cut, np.append(cut[1:], len(path)) - 1


def token_spans(path_runs: list[Run], sizes: list[int], blank: int = 0) -> list[tuple[int, int]]:
    """First and last frame of each token, which takes ``sizes`` labels: half of the blanks beside it, all of those at the ends."""
    label, first, last = np.array(path_runs, np.int64).reshape(-1, 3).T
    return list(zip(*(x.tolist() for x in _token_spans(label, first, last, sizes, blank)), strict=True))


def _token_spans(label: np.ndarray, first: np.ndarray, last: np.ndarray, sizes: list[int], blank: int) -> tuple[np.ndarray, np.ndarray]:
    spoken, sizes = np.flatnonzero(label != blank), np.array(sizes, np.int64)
    if sizes.sum() != len(spoken):
        raise ValueError("the path doesn't spell the tokens")
    some = np.flatnonzero(sizes)
    if not len(some):
        return np.zeros_like(sizes), np.zeros_like(sizes)
    until = np.cumsum(sizes)[some]
    a, b = spoken[until - sizes[some]], spoken[until - 1]
    # a blank on either side of all runs would be one of no frames
    quiet = np.concatenate([[False], label == blank, [False]])
    before, after = np.maximum(a - 1, 0), np.minimum(b + 1, len(label) - 1)
    start = np.where(quiet[a], (first[before] + last[before]) // 2, first[a])
    end = np.where(quiet[b + 2], (first[after] + last[after]) // 2, last[b])
    if sizes[0] and quiet[a[0]]:
        start[0] = first[before[0]]
    if sizes[-1] and quiet[b[-1] + 2]:
        end[-1] = last[after[-1]]
    # a token without labels is where the one before ends
    at = np.cumsum(sizes > 0) - 1
    ends = np.where(at < 0, 0, end[at])
    return np.where(sizes > 0, start[at], ends), ends


def word_times(spans: list[tuple[int, int]], stride_ms: float) -> list[tuple[float, float]]:
    """Seconds of frame spans, each start moved up to the end before."""
    return list(zip(*(x.tolist() for x in _seconds(*np.array(spans, np.int64).reshape(-1, 2).T, stride_ms)), strict=True))


def _seconds(first: np.ndarray, last: np.ndarray, stride_ms: float) -> tuple[np.ndarray, np.ndarray]:
    start, end = first * stride_ms / 1000, (last + 1) * stride_ms / 1000
    start[1:] = np.maximum(start[1:], end[:-1])
    return start, end


def frame_geometry(window_s: float, context_s: float, ratio: int, rate: int = 16_000) -> tuple[int, int]:
    """(frames in a window, frames of context) where a frame is ``ratio`` samples; both must divide evenly."""
    window, context = window_s * rate / ratio, context_s * rate / ratio
    if window != int(window) or context != int(context):
        raise ValueError("window and context must be whole frames")
    return int(window), int(context)


def stitched(samples: int, outputs: list[np.ndarray], window: int, context: int, ratio: int) -> np.ndarray:
    """Emissions of overlapping windows without their context and the frames past the end, with a zero column for the star."""
    core = np.concatenate([x[context : context + window] for x in outputs])
    extra = len(outputs) * window * ratio - samples
    core = core[: len(core) - extra // ratio]
    return np.concatenate([core, np.zeros((len(core), 1), core.dtype)], axis=1)


def windowed_rows(frames: DataFrame, frame: str, window: int, context: int) -> DataFrame:
    """``frames`` without ``frame``, with ``window_index`` and ``at``: each row in every window that sees it, at its place in the window."""
    first = F.greatest(F.lit(0), F.floor((F.col(frame) - context - window) / window) + 1)
    last = F.floor((F.col(frame) + context) / window)
    seen = frames.withColumn("window_index", F.explode(F.sequence(first, last)))
    return seen.withColumn("at", F.col(frame) - F.col("window_index") * window + context).drop(frame)


def stitched_rows(scores: DataFrame, frame: str, window: int, context: int, frames: str | None = None) -> DataFrame:
    """The rows ``scores(window_index, at, ...)`` of all windows as one sequence: each frame from the window whose core it is in, with its index over all.

    A frame's index follows from its window and its place there, so that no
    recording is gathered.  ``frames`` is a column with the recording's number of
    frames, past which those of the last window are left out.
    """
    core = scores.filter((F.col("at") >= context) & (F.col("at") < context + window))
    out = core.withColumn(frame, F.col("window_index") * window + F.col("at") - context)
    return (out if frames is None else out.filter(F.col(frame) < F.col(frames))).drop("window_index", "at")


def window_scores(recordings: DataFrame, model: Callable[[np.ndarray], np.ndarray], window: int, context: int, ratio: int, batch: int = 8) -> DataFrame:
    """``recordings(job_index, pcm)`` of 16-bit samples -> ``(job_index, frame, scores)``: log-probabilities with a zero for the star, a row a frame.

    ``window`` and ``context`` are frames of ``ratio`` samples.  Each window is
    a row of its own, so that one recording is scored by many tasks; ``model``
    gets up to ``batch`` windows (rows x samples, missing samples zero) and gives
    (rows x frames x labels).  A window takes its own samples from the
    recording's, and the frames past its end are left out.
    """
    size = window * ratio
    jobs = recordings.select("job_index", "pcm", F.floor(F.octet_length("pcm") / 2).cast("long").alias("samples")).filter("samples > 0")
    seen = context_windows(jobs, "samples", size, context * ratio)
    clips = seen.select("job_index", "window_index", "left_pad", "samples", F.substring("pcm", (2 * F.col("begin") + 1).cast("int"), (2 * (F.col("end") - F.col("begin"))).cast("int")).alias("clip"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), batch):
                part = pdf.iloc[k : k + batch]
                x = np.zeros((len(part), size + 2 * context * ratio))
                for row, clip, left in zip(x, part["clip"], part["left_pad"], strict=True):
                    row[left : left + len(clip) // 2] = np.frombuffer(clip, "<i2")
                out = np.asarray(model(x))
                if out.shape[1] < context + window:
                    raise ValueError("too few frames for the window")
                out = out[:, context : context + window]
                top = out.max(2, keepdims=True)
                out = out - top - np.log(np.exp(out - top).sum(2, keepdims=True))
                star = np.zeros((*out.shape[:2], 1))
                rows = list(np.concatenate([out, star], axis=2).reshape(-1, out.shape[2] + 1))
                index = part[["job_index", "window_index", "samples"]].loc[part.index.repeat(window)]
                yield index.assign(at=np.tile(np.arange(window), len(part)) + context, scores=rows)

    kind = dict(recordings.dtypes)["job_index"]
    made = clips.repartition("job_index", "window_index").mapInPandas(run, f"job_index {kind}, window_index long, samples long, at long, scores array<double>")
    # the last window's frames past the end, as whole frames of its missing samples
    total = F.ceil(F.col("samples") / size) * window - F.floor((F.ceil(F.col("samples") / size) * size - F.col("samples")) / ratio)
    return stitched_rows(made.withColumn("total", total), "frame", window, context, "total").select("job_index", "frame", "scores")


def vocabulary(labels: dict[str, int], columns: int, blanks: tuple[str, ...] = ("<blank>", "<pad>", "[PAD]", "|")) -> tuple[dict[str, int], dict[int, str], int]:
    """(label to column, column to label, blank's column): lower-cased, with the star as the last column."""
    lower = {k.lower(): v for k, v in labels.items()} | {"<star>": columns - 1}
    blank = next((lower[b.lower()] for b in blanks if b.lower() in lower), 0)
    return lower, {v: k for k, v in lower.items()}, blank


def plain_tokens(text: str) -> list[str]:
    """Each word's letters a to z and apostrophes; :func:`romanize.roman_tokens` knows other scripts."""
    words = text.split()
    return re.sub("[^a-z' ]+", "", " ".join(words).lower()).split(" ") if words else []


def segment_words(scores: np.ndarray, text: str, start: float, end: float, ids: dict[str, int], stride_ms: float, tokens: Callable[[str], list[str]] = plain_tokens) -> list[Word]:
    """(word, start, end, source) of a segment: each word after a star, aligned with the best path.

    Words keep within the segment, in order.  Fewer than two frames, or scores
    that can't spell the words, give uniform timing with its own source.
    """
    return words_of([(scores, text, start, end)], ids, stride_ms, tokens)[0]


def words_of(segments: list[tuple[np.ndarray, str, float, float]], ids: dict[str, int], stride_ms: float, tokens: Callable[[str], list[str]] = plain_tokens) -> list[list[Word]]:
    """:func:`segment_words` of each (scores, text, start, end), with the paths of all of them at once."""
    spelt = [_spelt(scores, text, ids, tokens) for scores, text, _, _ in segments]
    some = [k for k, t in enumerate(spelt) if t]
    paths = dict(zip(some, best_paths([(segments[k][0], [x for t in spelt[k] for x in t]) for k in some]), strict=True))
    return [_timed(text.split(), start, end, spelt[k], paths.get(k), stride_ms) for k, (_, text, start, end) in enumerate(segments)]


def _spelt(scores: np.ndarray, text: str, ids: dict[str, int], tokens: Callable[[str], list[str]]) -> list[list[int]] | None:
    """The labels of each word after a star; null if there are too few frames, or labels that the scores can't have."""
    try:
        star = scores.shape[1] - 1
        spelt = [[star, *[ids[c] for c in t if c in ids]] for t in tokens(text)]
    except (ValueError, IndexError):
        return None
    if len(scores) < 2 or len(spelt) != len(text.split()) or any(not 0 < x <= star for t in spelt for x in t):
        return None
    return spelt


def _timed(words: list[str], start: float, end: float, spelt: list[list[int]] | None, path: np.ndarray | None, stride_ms: float) -> list[Word]:
    try:
        if path is None:
            raise ValueError("no path")
        first, last = _token_spans(*_runs(path), [n for t in spelt for n in (1, len(t) - 1)], 0)
    except (ValueError, IndexError):
        step = max(0.0, end - start) / max(1, len(words))
        return [(w, start + k * step, start + (k + 1) * step, "uniform_fallback") for k, w in enumerate(words)]
    begin, until = _seconds(first[1::2], last[1::2], stride_ms)
    begin = np.minimum(end, np.maximum(start, start + begin))
    until = np.minimum(end, np.maximum(begin, start + until))
    return list(zip(words, begin.tolist(), until.tolist(), ["ctc"] * len(words), strict=True))


#: Cells of the scores that are held at once.
HELD = 1 << 22


def _parts(rows: list[tuple], scores: Scores) -> Iterator[list[tuple]]:
    """``rows(job, segment_index, text, start, end)`` as (job, segment_index, scores, text, start, end), as many at once as HELD cells allow."""
    part, cells = [], 0
    for key, index, *segment in rows:
        got = scores(*segment)
        if part and cells + got.size > HELD:
            yield part
            part, cells = [], 0
        part.append((key, index, got, *segment))
        cells += got.size
    if part:
        yield part


def aligned_words(segments: DataFrame, scores: Scores, ids: dict[str, int], stride_ms: float, job: str = "job") -> DataFrame:
    """``(job, segment_index, word_index, word, word_start, word_end, timing_source)`` of ``segments(job, segment_index, text, start, end)``; blank texts have no words.

    The work is in the paths and not in the rows' bytes, so the segments go to
    as many tasks as a shuffle has, however few bytes they are.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            held = [x for x in zip(pdf[job], pdf["segment_index"], pdf["text"], pdf["start"], pdf["end"], strict=True) if x[2] and x[2].strip()]
            # those of about one length together
            held.sort(key=lambda x: len(x[2]))
            for part in _parts(held, scores):
                got = words_of([x[2:] for x in part], ids, stride_ms)
                of, place = [k for k, words in enumerate(got) for _ in words], [k for words in got for k in range(len(words))]
                keys = pd.DataFrame([x[:2] for x in part], columns=[job, "segment_index"]).iloc[of].reset_index(drop=True)
                words = pd.DataFrame([word for words in got for word in words], columns=["word", "word_start", "word_end", "timing_source"])
                yield keys.assign(word_index=place).join(words)

    kinds = dict(segments.dtypes)
    tasks = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = segments.select(job, "segment_index", "text", "start", "end").repartition(tasks, job, "segment_index")
    return spread.mapInPandas(run, f"{job} {kinds[job]}, segment_index {kinds['segment_index']}, word_index long, word string, word_start double, word_end double, timing_source string")
