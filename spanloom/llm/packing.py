"""Best-fit packing of token sequences by fitted length patterns.

Texts are tokenised and cut into pieces.  The histogram of piece lengths, whose
size is the capacity whatever the corpus, goes to the driver.  There, patterns
of few lengths that fill a sequence are enumerated, their repeat counts are
fitted to the histogram by non-negative least squares, rounded down to what
the histogram holds, and the pieces left over are packed best-fit decreasing,
by counts and not one by one.  The plan is a list of (pattern, count) runs.

A piece finds its place from its rank among the pieces of its length: its rank
within the task that cut it, stored with it, plus the counts of earlier tasks.
So no length is ever gathered in one task.  The counts are joined by task and
length, a table of at most tasks x capacity rows.

Defined results: a null text is empty and gives the end token alone; repeated
rows are packed like any others; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.worker import once
from ..sources.scratch import Scratch

#: Entries that a worker's cache of encoded words holds before it starts again.
CACHE = 1_200_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte-level BPE ranks of a ``tokenizers`` JSON file, or of a ``.tiktoken`` file."""
    if not path.endswith(".json"):
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
    # byte-level files write each byte as a printable character
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    return {bytes(byte[c] for c in t): n for t, n in model["vocab"].items() if all(c in byte for c in t) and not (t.startswith("<|") and t.endswith("|>"))}


def read_added(path: str) -> dict[str, int]:
    """The strings of a ``tokenizers`` JSON file that are one token wherever they stand in a text."""
    if not path.endswith(".json"):
        return {}
    added = json.loads(Path(path).read_text(encoding="utf-8"))["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
        raise ValueError("added tokens that take blanks or need word ends aren't read")
    return {t["content"]: t["id"] for t in added}


#: Fixed value: the byte-level pre-tokeniser's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit integers.

    The text is cut at the ``added`` strings first, which have ids of their own.
    A token never spans the blank before a word, so a text without a blank
    before other white space is encoded blank by blank, from a cache.
    """

    def __init__(self, ranks: dict[bytes, int], added: dict[str, int] | None = None):
        import tiktoken

        self.added = added or {}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split

        self.encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.unsafe = re.compile(r" \s").search
        self.words: dict[bytes, bytes] = {}

    def _new(self, word: bytes) -> bytes:
        ids = self.words[word] = array("I", self.encode(" " + word.decode("utf-8", "replace"))).tobytes()
        return ids

    def __call__(self, text: str) -> bytes:
        if any(a in text for a in self.added):
            # every second part is an added token
            return b"".join(self.added[p].to_bytes(4, "little") if k % 2 else self.ordinary(p) for k, p in enumerate(self.cut(text)))
        return self.ordinary(text)

    def ordinary(self, text: str) -> bytes:
        if self.unsafe(text):
            return array("I", self.encode(text)).tobytes()
        first, *rest = text.encode("utf-8", "replace").split(b" ")
        known = self.words
        if len(known) > CACHE:
            known.clear()
        get, new = known.get, self._new
        return array("I", self.encode(first.decode())).tobytes() + b"".join([get(w) or new(w) for w in rest])


def pieces(df: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, piece, start, length, ids_crc32, part, rank)``: the pieces of each text; rank is among those of its length in its task."""
    ranks, added = read_ranks(tokenizer), read_added(tokenizer)
    shared, shared_key = df.sparkSession.sparkContext.broadcast((ranks, added)), zlib.crc32(repr((sorted(ranks.items()), added)).encode())
    schema = T.StructType(
        [T.StructField("id", df.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")), T.StructField("part", T.IntegerType()), T.StructField("rank", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = once(f"encoder{shared_key}", lambda: Encoder(*shared.value)), TaskContext.get().partitionId()
        end, seen = array("I", [end_id]).tobytes(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            row, piece, start, length, crc, rank = [], [], [], [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                ids = encode(text or "") + end
                total = len(ids) // 4
                cut = (total - 1) % capacity + 1
                for j, at in enumerate([0, *range(cut, total, capacity)]):
                    n = cut if j == 0 else capacity
                    row.append(k)
                    piece.append(j)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + n)]))
                    rank.append(int(seen[n]))
                    seen[n] += 1
            ints = [pa.array(x, pa.int64()) for x in (start, length, crc)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *ints, pa.array([part] * len(row), pa.int32()), pa.array(rank, pa.int64())], names=schema.names
            )

    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


Run = tuple[tuple[int, ...], int]


def patterns(lengths: list[int], capacity: int, steps: int = 24) -> list[tuple[int, ...]]:
    """Patterns of up to three of the given lengths that fill the capacity: all pairs, and for each length ``steps`` second ones."""
    have = set(lengths)
    out = {(a, capacity - a) for a in have if capacity - a in have and 2 * a >= capacity}
    for a in have:
        seconds = [b for b in lengths if b <= a and b >= (capacity - a) / 2 and capacity - a - b in have]
        for b in seconds[:: max(1, len(seconds) // steps)]:
            out.add(tuple(sorted((a, b, capacity - a - b), reverse=True)))
    for a in have:
        if a < capacity and capacity % a == 0:
            out.add((a,) * (capacity // a))
    return sorted(out, reverse=True)


def fit(pats: list[tuple[int, ...]], need: np.ndarray, rounds: int = 1500) -> np.ndarray:
    """Repeat counts x >= 0 that minimise ||A x - need||, by accelerated projected gradient steps on the sparse columns."""
    col = np.repeat(np.arange(len(pats)), [len(p) for p in pats])
    row = np.fromiter((n for p in pats for n in p), np.int64, len(col))
    x = y = np.zeros(len(pats))
    # no eigenvalue of A'A exceeds the greatest column sum times the greatest row sum
    step = 1 / max(1, np.bincount(row).max() * max(len(p) for p in pats))
    t = 1.0
    for _ in range(rounds):
        miss = np.bincount(row, y[col], len(need)) - need
        after = np.maximum(0, y - step * np.bincount(col, miss[row], len(pats)))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = after + (t - 1) / t2 * (after - x)
        x, t = after, t2
    return x


def best_fit(left: np.ndarray, capacity: int) -> list[Run]:
    """Best-fit decreasing by counts: runs of sequences with equal contents are filled together."""
    open_bins: list[list[Run]] = [[] for _ in range(capacity + 1)]
    for size in range(capacity, 0, -1):
        n = int(left[size])
        while n:
            free = next((f for f in range(size, capacity) if open_bins[f]), None)
            if free is None:
                per = capacity // size
                if n >= per:
                    open_bins[capacity - per * size].append(((size,) * per, n // per))
                if n % per:
                    open_bins[capacity - n % per * size].append(((size,) * (n % per), 1))
                break
            content, count = open_bins[free].pop()
            used = min(n, count)
            if used < count:
                open_bins[free].append((content, count - used))
            open_bins[free - size].append(((*content, size), used))
            n -= used
    return [r for bins in open_bins for r in bins]


def plan(histogram: dict[int, int], capacity: int) -> list[Run]:
    """Runs (pattern, count) that hold exactly the histogram's pieces."""
    left = np.zeros(capacity + 1, np.int64)
    for size, n in histogram.items():
        left[size] = n
    runs: list[Run] = [((capacity,), int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    pats = patterns([int(n) for n in np.flatnonzero(left)], capacity)
    if pats:
        x = fit(pats, left.astype(np.float64))
        for k in np.argsort(-x, kind="stable"):
            sizes, times = np.unique(pats[k], return_counts=True)
            n = int(min(np.floor(x[k] + 1e-6), (left[sizes] // times).min()))
            if n > 0:
                left[sizes] -= n * times
                runs.append((pats[k], n))
    return runs + best_fit(left, capacity)


def places(runs: list[Run]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, times in a sequence, offset of the first) in order of rank."""
    table: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for content, count in runs:
        ordered, at = sorted(content, reverse=True), 0
        for size in sorted(set(ordered), reverse=True):
            times = ordered.count(size)
            table.setdefault(size, []).append((ranks.get(size, 0), sequence, times, at))
            ranks[size] = ranks.get(size, 0) + times * count
            at += times * size
        sequence += count
    return {size: np.array(rows, np.int64) for size, rows in table.items()}


def locate(table: dict[int, np.ndarray], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece."""
    sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
    for size in np.unique(length):
        at = np.flatnonzero(length == size)
        rows = table[int(size)]
        run = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1]
        within = rank[at] - run[:, 0]
        sequence[at] = run[:, 1] + within // run[:, 2]
        offset[at] = run[:, 3] + within % run[:, 2] * size
    return sequence, offset


def pack(df: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: ``id_col, piece, start, length, ids_crc32, sequence_id, offset``."""
    cut = Scratch(df.sparkSession, "packing").save(pieces(df, tokenizer, capacity, end_id, id_col, text_col))
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = df.sparkSession.sparkContext.broadcast(places(plan(histogram, capacity)))
    ranked = cut.join(earlier, ["part", "length"]).select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("earlier")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = locate(table.value, batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    return ranked.mapInArrow(run, T.StructType([*ranked.schema.fields[:-1], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
