"""Alignment of two tokenizers over each text, and counts of linked token pairs over all texts.

A text's tokens of either kind tile the same bytes.  Tokens of the two kinds
whose byte ranges overlap are linked; the links are a bipartite graph, and its
connected components, found by union-find, are the minimal groups that both
tokenizers end together.  The members of a component are expanded into its
links.  How many texts hold an id pair linked is counted by Spark over the
texts' sets of pairs, and joined back to each text's pairs.

A blank between two visible characters ends a token of both kinds, so a text
is encoded chunk by chunk, and chunks that occur again come from a cache.  The
graphs of many texts are one graph, whose components are found at once; a very
long text is cut at such blanks, so that memory doesn't grow with it.

Defined results: texts that are null or empty, or that either tokenizer
doesn't give back byte for byte, have no tokens: zeros and an empty hash.
Strings of special tokens are plain text.  Each row counts as a text of its
own, so repeated rows and ids count as often as they occur; null ids stay.
Texts are read whole, whatever their length.  Columns of other names are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.worker import once
from ..sources.scratch import Scratch
from .packing import Encoder, read_ranks

#: Chunks that a worker's cache holds before it starts again, and the longest one it keeps.
CACHE, LONGEST = 500_000, 48
#: Distinct pairs whose counts may be sent to every task; Spark joins more of them by shuffle.
PAIRS = 1_000_000
#: Characters that are aligned at once, and rows that leave a task together.
STRETCH, ROWS = 200_000, 500

#: A blank that ends tokens of both kinds: no token has a visible character before a blank.
CUT = re.compile(r"(?<=\S) (?=\S)")
UNSAFE = re.compile(r"\s | \s|^ | \Z").search


class Pieces:
    """Ids of a text by a sentencepiece model that puts a blank before it, as little-endian unsigned 32-bit integers.

    A text is encoded chunk by chunk from a cache; None if the model doesn't give it back.
    """

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.model = p = SentencePieceProcessor(model_proto=model)
        names = [p.id_to_piece(n) for n in range(p.get_piece_size())]
        if any("▁" in name.lstrip("▁") for name in names):
            raise ValueError("a piece has a blank after another character, so texts can't be cut at blanks")
        self.texts = [bytes([int(name[3:5], 16)]) if p.is_byte(n) else name.replace("▁", " ").encode() for n, name in enumerate(names)]
        self.known: dict[str, bytes | None] = {}

    def _learn(self, chunks: list[str]) -> dict[str, bytes | None]:
        made = {}
        for chunk, ids in zip(chunks, self.model.encode(chunks, num_threads=1), strict=True):
            fine = b"".join([self.texts[n] for n in ids]) == b" " + chunk.encode()
            made[chunk] = array("I", ids).tobytes() if fine else None
        if len(self.known) > CACHE:
            self.known.clear()
        self.known |= {chunk: ids for chunk, ids in made.items() if len(chunk) <= LONGEST}
        return made

    def __call__(self, text: str) -> bytes | None:
        chunks = CUT.split(text) if UNSAFE(text) else text.split(" ")
        try:
            ids = [self.known[c] for c in chunks]
        except KeyError:
            # the cache can start again, so what this text has is kept aside
            own = {c: self.known[c] for c in set(chunks) if c in self.known}
            own |= self._learn([c for c in set(chunks) if c not in own])
            ids = [own[c] for c in chunks]
        return None if None in ids else b"".join(ids)


def united(nodes: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least node of each node's connected component: union-find over all edges at once.

    Each round hooks the roots that an edge joins, the larger to the smaller
    one, and then halves all paths until every node points at its root.
    """
    up = np.arange(nodes)
    while True:
        a, b = up[u], up[v]
        apart = a != b
        if not apart.any():
            return up
        # only edges between two roots go on
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        up[np.maximum(a, b)] = np.minimum(a, b)
        while True:
            half = up[up]
            if (half == up).all():
                break
            up = half


class Aligned(NamedTuple):
    """The alignment of one stretch of text: numbers, linked pairs with their occurrences, and the groups as text."""

    n_a: int
    n_b: int
    n_groups: int
    n_links: int
    pairs: np.ndarray
    times: np.ndarray
    groups: bytes


class Aligner:
    """Aligns many stretches of text at once."""

    def __init__(self, ranks: dict[bytes, int], model: bytes):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a byte has no token, so texts may not come back")
        self.encoder, self.pieces = Encoder(ranks), Pieces(model)
        top = max(ranks.values()) + 1
        self.a_size = np.zeros(top, np.int64)
        for text, n in ranks.items():
            self.a_size[n] = len(text)
        self.b_size = np.array([len(t) for t in self.pieces.texts])
        # ids as text, with what comes after them inside a group and at the end of its side
        self.shown = [b"%d%s" % (n, end) for count, ends in ((top, (b",", b"|")), (len(self.b_size), (b",", b";"))) for end in ends for n in range(count)]

    def __call__(self, texts: list[str]) -> list[Aligned | None]:
        """The alignment of each text; None for those that don't come back."""
        kept, ids = [], []
        for k, text in enumerate(texts):
            b = self.pieces(text)
            if b is not None:
                kept.append(k)
                ids.append((np.frombuffer(self.encoder.ordinary(" " + text), np.uint32).astype(np.int64), np.frombuffer(b, np.uint32).astype(np.int64)))
        out: list[Aligned | None] = [None] * len(texts)
        if kept:
            for k, made in zip(kept, self._tiled([a for a, _ in ids], [b for _, b in ids]), strict=True):
                out[k] = made
        return out

    def _tiled(self, of_a: list[np.ndarray], of_b: list[np.ndarray]) -> list[Aligned]:
        a, b = np.concatenate(of_a), np.concatenate(of_b)
        a_cut, b_cut = (np.cumsum([0, *map(len, x)]) for x in (of_a, of_b))
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        ends_a, ends_b = (np.zeros(a_ends[-1] + 1, bool) for _ in range(2))
        ends_a[a_ends] = ends_b[b_ends] = True
        # two tokens overlap in one stretch between neighbouring ends of either side
        ends = np.flatnonzero(ends_a | ends_b)
        i, j = (np.cumsum(x)[ends] - x[ends] for x in (ends_a, ends_b))
        root = united(len(a) + len(b), i, len(a) + j)
        # the least member of a group is a token of the first side, so its places number the groups
        first = root[: len(a)] == np.arange(len(a))
        group_a = np.cumsum(first) - 1
        group_b = group_a[root[len(a) :]]
        # the members of each group in turn, as text
        b_before = np.concatenate([[0], np.cumsum(np.bincount(group_b, minlength=group_a[-1] + 1))])
        a_until = np.cumsum(np.bincount(group_a))
        named = np.empty(len(a) + len(b), np.int64)
        last = lambda g: np.append(g[1:] != g[:-1], True)
        named[np.arange(len(a)) + b_before[group_a]] = a + len(self.a_size) * last(group_a)
        named[np.arange(len(b)) + a_until[group_b]] = 2 * len(self.a_size) + b + len(self.b_size) * last(group_b)
        # the links of each text, sorted, with their occurrences
        owner = np.searchsorted(a_cut, i, side="right") - 1
        links = np.sort(owner << 32 | a[i] * len(self.b_size) + b[j])
        new = np.flatnonzero(np.append(True, links[1:] != links[:-1]))
        times, links = np.diff(np.append(new, len(links))), links[new]
        code = links & 0xFFFFFFFF
        pairs = code // len(self.b_size) << 32 | code % len(self.b_size)
        cut = np.searchsorted(links >> 32, np.arange(len(of_a) + 1))
        n_groups, n_links = np.add.reduceat(first, a_cut[:-1]), np.bincount(owner, minlength=len(of_a))
        shown = self.shown.__getitem__
        out = []
        for k in range(len(of_a)):
            text = b"".join(map(shown, named[a_cut[k] + b_cut[k] : a_cut[k + 1] + b_cut[k + 1]].tolist()))[:-1]
            out.append(Aligned(len(of_a[k]), len(of_b[k]), int(n_groups[k]), int(n_links[k]), pairs[cut[k] : cut[k + 1]], times[cut[k] : cut[k + 1]], text))
        return out


def stretches(text: str, most: int) -> Iterator[str]:
    """A long text cut at blanks that end tokens, into stretches of ``most`` characters, or of more where there is no such blank."""
    start = 0
    while len(text) - start > most and (found := CUT.search(text, start + most)):
        yield text[start : found.start()]
        start = found.end()
    yield text[start:]


class Row:
    """A text's alignment, stretch after stretch."""

    def __init__(self) -> None:
        self.numbers = np.zeros(4, np.int64)
        self.digest = hashlib.sha256()
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.fine = True

    def add(self, made: Aligned | None) -> None:
        if made is None:
            self.fine = False
        elif self.fine:
            self.digest.update(b";" + made.groups if self.parts else made.groups)
            self.numbers += made[:4]
            self.parts.append((made.pairs, made.times))

    def result(self) -> Aligned:
        if not self.fine or not self.parts:
            return Aligned(0, 0, 0, 0, np.zeros(0, np.int64), np.zeros(0, np.int64), b"")
        pairs, times = self.parts[0]
        if len(self.parts) > 1:
            pairs, at = np.unique(np.concatenate([p for p, _ in self.parts]), return_inverse=True)
            times = np.bincount(at, np.concatenate([t for _, t in self.parts])).astype(np.int64)
        return Aligned(*map(int, self.numbers), pairs, times, self.digest.hexdigest().encode())


def rows_of(texts: list[str | None], aligner: Aligner) -> list[Aligned]:
    """The whole alignment of each text, its groups hashed; zeros where there is none."""
    rows, waiting, size = [Row() for _ in texts], [], 0

    def close() -> None:
        for (k, _), made in zip(waiting, aligner([t for _, t in waiting]), strict=True):
            rows[k].add(made)
        waiting.clear()

    for k, text in enumerate(texts):
        for part in stretches(text, STRETCH) if text else ():
            waiting.append((k, part))
            size += len(part)
            if size > STRETCH:
                close()
                size = 0
    close()
    return [r.result() for r in rows]


NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def alignments(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, row, n_a, n_b, n_groups, n_links, groups_sha256, pairs(pair, times))`` for each row; ``row`` tells rows apart, a pair is the first id times 2**32 and the second."""
    shared = df.sparkSession.sparkContext.broadcast((read_ranks(a_path), Path(b_path).read_bytes()))
    key = f"aligner{zlib.crc32(repr((a_path, b_path)).encode())}"
    linked = T.ArrayType(T.StructType([T.StructField("pair", T.LongType()), T.StructField("times", T.LongType())]))
    schema = T.StructType(
        [T.StructField("id", df.schema[id_col].dataType), T.StructField("row", T.LongType()), *(T.StructField(n, T.LongType()) for n in NUMBERS), T.StructField("groups_sha256", T.StringType()), T.StructField("pairs", linked)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = once(key, lambda: Aligner(*shared.value))
        row = TaskContext.get().partitionId() << 33

        def out(ids: pa.Array, made: list[Aligned]) -> pa.RecordBatch:
            offsets = pa.array(np.cumsum([0, *(len(m.pairs) for m in made)]), pa.int32())
            members = pa.StructArray.from_arrays([np.concatenate([m.pairs for m in made]), np.concatenate([m.times for m in made])], names=["pair", "times"])
            numbers = [pa.array([m[k] for m in made], pa.int64()) for k in range(4)]
            return pa.RecordBatch.from_arrays([ids, pa.array(np.arange(row, row + len(made))), *numbers, pa.array([m.groups.decode() for m in made]), pa.ListArray.from_arrays(offsets, members)], names=schema.names)

        for batch in batches:
            # so many rows at a time that their pairs, and the rows' own copies, stay small
            for first in range(0, batch.num_rows, ROWS):
                made = rows_of(batch.column(1).slice(first, ROWS).to_pylist(), aligner)
                yield out(batch.column(0).slice(first, len(made)), made)
                row += len(made)

    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``(pair, n, best)``: how many rows hold the pair linked, and whether no pair of its first id is held by more."""
    counts = aligned.select(F.explode("pairs.pair").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    # a first id has at most as many pairs as the second vocabulary has ids
    return counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy(F.shiftright("pair", 32))))


def cross_align(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", *, send: int = PAIRS) -> DataFrame:
    """``(id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` for each row.

    ``a_path`` is a byte-level BPE file, ``b_path`` a sentencepiece model.
    ``n_best`` has the links whose pair no other pair of its first id
    outnumbers, ``count_sum`` the sum of the pairs' counts over all links.
    Up to ``send`` distinct pairs are sent to every task.
    """
    scratch = Scratch(df.sparkSession, "crosstok")
    aligned = scratch.save(alignments(df, a_path, b_path, id_col, text_col))
    counts = scratch.save(pair_counts(aligned))
    if counts.count() <= send:
        counts = F.broadcast(counts)
    keys = ["row", "id", *NUMBERS, "groups_sha256"]
    held = aligned.select(*keys, F.explode_outer("pairs").alias("p")).select(*keys, "p.pair", "p.times").join(counts, "pair", "left")
    # a row's pairs come from one task, which sums them before the exchange
    summed = held.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("best"), F.col("times"))), F.lit(0)).alias("n_best"), F.coalesce(F.sum(F.col("n") * F.col("times")), F.lit(0)).alias("count_sum"))
    return summed.select(F.col("id").alias(id_col), *NUMBERS, "n_best", "count_sum", "groups_sha256")
