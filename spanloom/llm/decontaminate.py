"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

A seed is a run of ``width`` words of a test item.  A text that holds any seed
of an item is aligned with it around its seeds, word by word; the similarity
is the best local score over that of a whole copy.  No seed is too common to
count: a phrase in every text may be all that is left of an edited copy in
every text.  A text is spared an alignment only where it holds too few of the
item's words, near its seeds, to reach the least similarity.  A copy without
one unbroken run of ``width`` words has no seed and is not found: of random edits
that leave a similarity of 0.5 or more, those are 0 to 3 in a hundred.

Items are compared in blocks of at most ``block_bytes`` of text (or of one item),
a pass over the texts for each, so that a task holds one block.  No text is
shuffled, and no two texts are ever compared.

Defined results: null or empty texts hold nothing; items without words match
nothing; equal items are each reported; repeated rows are each judged; words
are compared with A-Z lower-cased and ASCII signs as blanks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.scratch import Scratch
from .lm import Index, encoded, groups, word_hashes
from .texts import others, with_text_columns

#: A-Z lower-cased, ASCII signs turned to blanks.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() or c > 127 else 32 for c in range(256))
MATCH, MISS, GAP = 2, -1, -1


def mixed(ids: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit name of each run of ``width`` ids."""
    out = np.zeros(max(0, len(ids) - width + 1), np.uint64)
    for k in range(width):
        out = (out ^ ids[k : k + len(out)].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out


class Seeds:
    """The items of a block as word ids, and the index of their seeds."""

    def __init__(self, items: list[tuple[Any, str | None]], width: int):
        self.width = width
        texts = [encoded(t).translate(WORDS) for _, t in items]
        h, owner = word_hashes(texts)
        names = np.unique(h)
        self.words = Index(names)
        ids = np.searchsorted(names, h) + 1
        self.items, keys, of, short = [], [], [], {}
        for k, (item, _) in enumerate(items):
            mine = ids[owner == k]
            if len(mine):
                at = len(self.items)
                self.items.append((item, mine))
                # an item shorter than a seed is one seed of its own width
                w = min(width, len(mine))
                runs = np.unique(mixed(mine, w))
                keys.append(runs)
                of.append(np.full(len(runs), at))
                short.setdefault(w, None)
        self.widths = sorted(short)
        self.key = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
        self.seeds = Index(self.key)
        flat, owner = (np.concatenate(keys), np.concatenate(of)) if keys else (self.key, self.key.astype(np.int64))
        self.of: dict[int, list[int]] = {}
        for seed, at in zip(np.searchsorted(self.key, flat).tolist(), owner.tolist(), strict=True):
            self.of.setdefault(seed, []).append(at)
        self.counts = [np.unique(words, return_counts=True) for _, words in self.items]

    def reachable(self, item: int, window: np.ndarray) -> float:
        """No less than the similarity of an item and a window: the share of the item's words that the window holds."""
        names, counts = self.counts[item]
        at = np.searchsorted(names, window)
        at[at == len(names)] = 0
        held = np.bincount(at[names[at] == window], minlength=len(names))
        return int(np.minimum(held, counts).sum()) / len(self.items[item][1])

    def hits(self, data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word ids of all texts in order, each word's text, position and seed of each hit)."""
        h, owner = word_hashes([t.translate(WORDS) for t in data])
        ids = self.words.find(h) + 1
        at, seed = [], []
        for w in self.widths:
            if len(ids) < w:
                continue
            n = len(ids) - w + 1
            whole = owner[:n] == owner[w - 1 :]
            for k in range(w):
                whole &= ids[k : k + n] > 0
            start = np.flatnonzero(whole)
            if len(start):
                found = self.seeds.find(mixed(ids, w)[start])
                at.append(start[found >= 0])
                seed.append(found[found >= 0])
        none = np.zeros(0, np.int64)
        return ids, owner, np.concatenate(at) if at else none, np.concatenate(seed) if seed else none


def align(window: np.ndarray, item: np.ndarray) -> int:
    """The best Smith-Waterman score of two sequences of ids; id 0 matches nothing."""
    n = len(window)
    steps = -GAP * np.arange(n + 1)
    row, best = np.zeros(n + 1, np.int64), 0
    for word in item:
        after = np.zeros(n + 1, np.int64)
        after[1:] = np.maximum(row[:-1] + np.where(window == word, MATCH, MISS), row[1:] + GAP)
        np.maximum(after, 0, out=after)
        # gaps along the window: the best earlier cell less its distance
        row = np.maximum.accumulate(after + steps) - steps
        best = max(best, int(row.max()))
    return best


def similarities(ids: np.ndarray, hits: list[tuple[int, int]], seeds: Seeds, least: float) -> list[tuple[int, float]]:
    """(item, similarity) for the items with seeds at the given positions of one text; zero where ``least`` is out of reach."""
    places: dict[int, list[int]] = {}
    for at, seed in hits:
        for item in seeds.of.get(seed, ()):
            places.setdefault(item, []).append(at)
    out = []
    for item, at in sorted(places.items()):
        words = seeds.items[item][1]
        reach = 2 * len(words)
        at.sort()
        best, k = 0, 0
        while k < len(at):
            # seeds within reach of each other share a window
            j = k
            while j + 1 < len(at) and at[j + 1] - at[j] <= reach:
                j += 1
            window = ids[max(0, at[k] - reach) : at[j] + reach]
            if seeds.reachable(item, window) >= least:
                best = max(best, align(window, words))
            k = j + 1
        out.append((item, best / (MATCH * len(words))))
    return out


def leaks(seeds: Seeds, texts: list[str | None], least: float) -> list[list[tuple[int, float]]]:
    """For each text, the (item, similarity) of at least ``least``."""
    out: list[list[tuple[int, float]]] = []
    for _, data in groups(texts):
        ids, owner, at, seed = seeds.hits(data)
        begin = np.searchsorted(owner, np.arange(len(data) + 1))
        of = owner[at]
        order = np.argsort(of, kind="stable")
        cut = np.searchsorted(of[order], np.arange(len(data) + 1))
        for k in range(len(data)):
            mine = order[cut[k] : cut[k + 1]]
            found = similarities(ids[begin[k] : begin[k + 1]], list(zip((at[mine] - begin[k]).tolist(), seed[mine].tolist(), strict=True)), seeds, least) if len(mine) else []
            out.append([(i, s) for i, s in found if s >= least])
    return out


def item_blocks(items: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[Any, str | None]]]:
    """The items on the driver, at most ``block_bytes`` of text (or one item) at a time."""
    block: list[tuple[Any, str | None]] = []
    size = 0
    for r in items.select(F.col(item_col), F.col(text_col).cast("string")).toLocalIterator():
        more = len(encoded(r[1]))
        if block and size + more > block_bytes:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += more
    if block:
        yield block


def with_leaks(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = 3, least: float = 0.5, block_bytes: int = 8 << 20, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``leaks``: the (item, similarity) of each test item that a text holds a copy of, edited or not."""
    sc, kind = docs.sparkSession.sparkContext, items.schema[item_col].dataType
    field = T.StructField("leaks", T.ArrayType(T.StructType([T.StructField("item", kind), T.StructField("similarity", T.DoubleType())])))
    arrow = to_arrow_type(field.dataType)

    def one_pass(df: DataFrame, block: list[tuple[Any, str | None]], keep: bool) -> tuple[DataFrame, Any]:
        shared = sc.broadcast(Seeds(block, width))

        def make() -> Callable[[list[str | None]], list[pa.Array]]:
            def columns(texts: list[str | None]) -> list[pa.Array]:
                names = [i for i, _ in shared.value.items]
                return [pa.array([[{"item": names[i], "similarity": s} for i, s in found] for found in leaks(shared.value, texts, least)], arrow)]

            return columns

        return with_text_columns(df, text_col, [field], make, keep), shared

    blocks = item_blocks(items, item_col, item_text, block_bytes)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        keep = others(docs, "leaks") if keep_text else others(docs, "leaks", text_col)
        return docs.select(*keep, F.array().cast(field.dataType).alias("leaks"))
    if second is None:
        return one_pass(docs, first, keep_text)[0]
    scratch = Scratch(docs.sparkSession, "leaks")
    # numbered once, so that the passes agree on the rows
    numbered = scratch.save(docs.select(*others(docs, "leaks"), F.monotonically_increasing_id().alias("\x00row")))
    found = []
    for block in chain((first, second), blocks):
        got, shared = one_pass(numbered.select("\x00row", text_col), block, keep=False)
        found.append(scratch.save(got.filter(F.size("leaks") > 0)))
        shared.destroy()
    every = reduce(DataFrame.unionByName, found).groupBy("\x00row").agg(F.array_sort(F.flatten(F.collect_list("leaks"))).alias("leaks"))
    keep = [c for c in (others(numbered) if keep_text else others(numbered, text_col)) if c != "\x00row"]
    return numbered.join(every, "\x00row", "left").select(*keep, F.coalesce("leaks", F.array().cast(field.dataType)).alias("leaks"))
