"""Language-model scoring by prediction by partial matching (PPM) over bytes.

A trie of byte contexts up to ``order`` symbols holds, for each context, the
symbols seen after it.  A symbol is coded at the longest seen context that has
it; each context without it costs an escape (method D: each distinct symbol
gives half a count to the escape).  After an escape, the symbols of the longer
context are excluded from the shorter one.  Order -1 is uniform over the 257
codes, 256 bytes and the end of a text, that are not excluded.  A text starts
in a context of start marks.

*Pretrained*: counts over all training texts are added up in tasks, then by a
shuffle.  Since every context is a suffix of the longer ones, the symbols
excluded at each step are those of one context, so that each context's
denominators can be made once and a text is scored by table look-ups.  The
trie goes to the tasks in shards of at most ``shard_entries`` leaves, split by
the last context byte: one pass over the texts for each shard.

*Adaptive*: each text is coded alone, counts growing as it is read.

The unigram base score looks up the counts of the most frequent words, at most
``head_words`` of them, in a broadcast table; the rest of the words go through
a join on their hash.

Defined results: a null text is empty, and scores its end alone; repeated rows
score alike, and each of them teaches; a row that the training condition is
null for, as it is for a null id where it is by id, is held out; an empty table
gives no rows; without training texts every code is uniform.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.worker import once
from ..sources.scratch import Scratch
from .texts import others

START, END, CODES, WIDTH = 256, 257, 257, 9
#: Bytes that a task looks at at once.
BLOCK = 1 << 20


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(XXH64 of each word in order, index of its text) for A-Z lower-cased words between blanks."""
    words = [t.lower().split() for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    h = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(words)), np.uint64, int(sizes.sum()))
    return h, np.repeat(np.arange(len(words)), sizes)


def windows(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(packed context and code at each position, first position of each text); a text has one position more than bytes."""
    sizes = np.array([len(t) for t in texts], np.int64) + order + 1
    at = np.concatenate([[0], np.cumsum(sizes)])
    codes = np.full(at[-1], START, np.uint64)
    body = np.ones(at[-1], bool)
    for k in range(order):
        body[at[:-1] + k] = False
    codes[at[1:] - 1] = END
    inner = body.copy()
    inner[at[1:] - 1] = False
    codes[inner] = np.frombuffer(b"".join(texts), np.uint8)
    key = codes.copy()
    for k in range(1, order + 1):
        key[k:] |= codes[: len(codes) - k] << np.uint64(WIDTH * k)
    first = at[:-1] - order * np.arange(len(texts))
    return key[body], first


def tally(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often (or with what sum) each occurs."""
    if counts is None:
        keys = np.sort(keys)
    else:
        by = np.argsort(keys)
        keys, counts = keys[by], counts[by]
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.diff(np.append(at, len(keys))) if counts is None else np.add.reduceat(counts, at)


class Tally:
    """Counts that grow by batches; merged whenever the parts outgrow the whole."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray) -> None:
        self.parts.append(tally(keys))
        if sum(len(k) for k, _ in self.parts[1:]) > max(1 << 20, len(self.parts[0][0])):
            self.parts = [self.all()]

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return tally(np.concatenate([k for k, _ in self.parts]), np.concatenate([n for _, n in self.parts]))


class Index:
    """Positions of distinct unsigned 64-bit keys, by open addressing."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(4, int(2.5 * max(1, len(keys))).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        todo = np.arange(len(keys), dtype=np.int32)
        slot = self._slot(keys)
        while len(todo):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = todo[free]
            left = self.slots[slot] != todo
            todo, slot = todo[left], (slot[left] + 1) & (len(self.slots) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The position of each key, or -1."""
        slot = self._slot(keys)
        out = self.slots[slot]
        if not len(self.keys):
            return out
        odd = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        while len(odd):
            slot_odd = slot[odd] = (slot[odd] + 1) & (len(self.slots) - 1)
            got = self.slots[slot_odd]
            out[odd] = got
            odd = odd[(got >= 0) & (self.keys[got] != keys[odd])]
        return out


class Model:
    """The tables of a trie shard: counts of (context, code) and of contexts at each order."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int, lower: list[tuple[np.ndarray, np.ndarray]] | None = None):
        """``lower``: keys and counts of the first orders in the whole trie, where ``keys`` are those of a shard."""
        self.order = order
        self.count, self.symbol, self.context, self.total, self.kinds, self.den, self.esc = [], [], [], [], [], [], []
        for k in range(order + 1):
            mask = np.uint64((1 << WIDTH * (k + 1)) - 1)
            keys_k, n = lower[k] if lower and k < len(lower) else tally(keys & mask, counts)
            ctx = keys_k >> np.uint64(WIDTH)
            at = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]])) if len(ctx) else np.zeros(0, np.int64)
            total = np.add.reduceat(n, at) if len(at) else n
            kinds = np.diff(np.append(at, len(ctx)))
            self.symbol.append(Index(keys_k))
            self.count.append(n)
            self.context.append(Index(ctx[at]))
            self.total.append(total)
            self.kinds.append(kinds)
            if k:
                # what is left of the next shorter context once this one's symbols are excluded
                shorter = self.count[k - 1][self.symbol[k - 1].find(keys_k & np.uint64((1 << WIDTH * k) - 1))]
                taken = np.add.reduceat(shorter, at) if len(at) else shorter
                up = self.context[k - 1].find(ctx[at] & np.uint64((1 << WIDTH * (k - 1)) - 1))
                self.esc.append((self.kinds[k - 1][up] - kinds) / 2)
                self.den.append(self.total[k - 1][up] - taken)
        top = order
        at = np.repeat(np.arange(len(self.kinds[top])), self.kinds[top])
        self.direct = np.log10((self.count[top] - 0.5) / self.total[top][at]) if len(at) else np.zeros(0)

    def score(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of the code at each position."""
        found = self.symbol[self.order].find(keys)
        out = np.zeros(len(keys))
        hit = found >= 0
        out[hit] = self.direct[found[hit]]
        todo = np.flatnonzero(~hit)
        child = np.full(len(todo), -1, np.int64)  # the longer context just escaped from
        for k in range(self.order, -1, -1):
            key = keys[todo] & np.uint64((1 << WIDTH * (k + 1)) - 1)
            ctx = self.context[k].find(key >> np.uint64(WIDTH)).astype(np.int64)
            seen = ctx >= 0
            first = seen & (child < 0)
            later = seen & (child >= 0)
            den, esc = np.ones(len(todo)), np.ones(len(todo))
            den[first] = self.total[k][ctx[first]]
            esc[first] = self.kinds[k][ctx[first]] / 2
            if k < self.order:
                den[later], esc[later] = self.den[k][child[later]], self.esc[k][child[later]]
            n = self.symbol[k].find(key)
            coded = n >= 0
            out[todo[coded]] += np.log10((self.count[k][n[coded]] - 0.5) / den[coded])
            # with every symbol of this order excluded, the escape is certain
            escaped = seen & ~coded & (den > 0)
            out[todo[escaped]] += np.log10(esc[escaped] / den[escaped])
            child = np.where(seen, ctx, child)[~coded]
            todo = todo[~coded]
        out[todo] -= math.log10(CODES - (int(self.kinds[0][0]) if len(self.kinds[0]) else 0)) if len(todo) else 0
        return out


class Trie:
    """A trie of nested dicts, coded one symbol at a time: the adaptive model, and a plain statement of the pretrained one."""

    def __init__(self, order: int):
        self.order = order
        self.nodes: dict[tuple[int, ...], dict[int, int]] = {}

    def learn(self, context: tuple[int, ...], code: int) -> None:
        for k in range(self.order + 1):
            node = self.nodes.setdefault(context[self.order - k :], {})
            node[code] = node.get(code, 0) + 1

    def cost(self, context: tuple[int, ...], code: int) -> float:
        """log10 probability of the code after the context."""
        out, excluded = 0.0, set()
        for k in range(self.order, -1, -1):
            node = self.nodes.get(context[self.order - k :])
            left = {s: n for s, n in node.items() if s not in excluded} if node else {}
            if not left:
                continue
            total = sum(left.values())
            if code in left:
                return out + math.log10((left[code] - 0.5) / total)
            out += math.log10(len(left) / 2 / total)
            excluded |= left.keys()
        return out - math.log10(CODES - len(excluded))

    def text(self, data: bytes, learn: bool) -> float:
        context, out = (START,) * self.order, 0.0
        for code in (*data, END):
            out += self.cost(context, code)
            if learn:
                self.learn(context, code)
            context = (*context, code)[1:]
        return out


def adaptive_scores(df: DataFrame, text_col: str = "text", order: int = 4) -> DataFrame:
    """``df`` without its text, with ``score``: each text's log10 probability under a model that it alone teaches as it is read."""
    keep = others(df, "score", text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [Trie(order).text(encoded(t), learn=True) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.float64())], names=[*keep, "score"])

    return df.select(*keep, F.col(text_col).cast("string").alias("\x00text")).mapInArrow(run, T.StructType([*(df.schema[c] for c in keep), T.StructField("score", T.DoubleType())]))


def encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def groups(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts as UTF-8, about ``BLOCK`` bytes together, with the index of the first."""
    part: list[bytes] = []
    size = first = 0
    for k, t in enumerate(texts):
        part.append(encoded(t))
        size += len(part[-1])
        if size >= BLOCK or k + 1 == len(texts):
            yield first, part
            part, size, first = [], 0, k + 1


def count_corpus(train: DataFrame, text_col: str, order: int) -> DataFrame:
    """``(kind, key, n)``: word hashes (0), packed contexts with codes (1) and texts (2) of all training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, trie, texts = Tally(), Tally(), 0
        for batch in batches:
            for _, part in groups(batch.column(0).to_pylist()):
                texts += len(part)
                words.add(word_hashes(part)[0])
                trie.add(windows(part, order)[0])
        for kind, (keys, n) in enumerate((words.all(), trie.all(), (np.zeros(1, np.uint64), np.array([texts])))):
            for k in range(0, len(keys), 1 << 16):
                part_n = np.asarray(n[k : k + (1 << 16)], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part_n), kind, np.int32)), pa.array(keys[k : k + (1 << 16)].view(np.int64)), pa.array(part_n)], names=["kind", "key", "n"])

    one = train.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "kind int, key long, n long")
    return one.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def arrays(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of a bounded count table, on the driver."""
    got = df.select("key", "n").toArrow()
    return tally(got.column("key").to_numpy().view(np.uint64), got.column("n").to_numpy().astype(np.int64))


@dataclass(frozen=True)
class Shard:
    """The contexts whose last ``depth`` codes are among ``ends``, and those that only end in one of ``parents``, which are of one code less, and in none of ``known``."""

    depth: int
    ends: tuple[int, ...] = ()
    parents: tuple[int, ...] = ()
    known: tuple[int, ...] = ()

    def own(self, keys: np.ndarray) -> np.ndarray:
        """Which packed keys belong to the shard."""
        if not self.depth:
            return np.ones(len(keys), bool)
        last = lambda n: (keys >> np.uint64(WIDTH)) & np.uint64((1 << WIDTH * n) - 1)
        among = lambda x, some: np.isin(x, np.array(some, np.uint64))
        return among(last(self.depth), self.ends) | (among(last(self.depth - 1), self.parents) & ~among(last(self.depth), self.known))

    def suffixes(self, n: int) -> list[int]:
        """The last ``n`` codes, less than ``depth``, of all its contexts."""
        return sorted({x & ((1 << WIDTH * n) - 1) for x in (*self.ends, *self.parents)})


def ending(n: int) -> Column:
    """The last ``n`` context codes of a packed key."""
    return F.shiftright("key", WIDTH).bitwiseAND((1 << WIDTH * n) - 1)


def trie_shards(trie: DataFrame, shard_entries: int, order: int) -> list[Shard]:
    """Shards of at most ``shard_entries`` leaves, or of one whole context.  Only sizes come here, 257 at most for each ending that is too large."""
    sizes = lambda df, n: {r.end: r["count"] for r in df.groupBy(ending(n).alias("end")).count().collect()}
    level, parents, shards = sizes(trie, min(1, order)), [0], []
    if sum(level.values()) <= shard_entries:
        return [Shard(0)]
    for depth in range(1, order + 1):
        large = [e for e in level if level[e] > shard_entries and depth < order]
        # contexts that no training text has go with the first of their depth
        parts, room = [[]], shard_entries
        for e in sorted(level.keys() - set(large)):
            if level[e] > room and parts[-1]:
                parts.append([])
                room = shard_entries
            parts[-1].append(e)
            room -= level[e]
        shards += [Shard(depth, tuple(p), *((tuple(parents), tuple(sorted(level))) if k == 0 else ())) for k, p in enumerate(parts)]
        if not large:
            break
        parents, level = large, sizes(trie.filter(ending(depth).isin(large)), depth + 1)
    return shards or [Shard(0)]


def shard_arrays(trie: DataFrame, shard: Shard) -> tuple[tuple[np.ndarray, np.ndarray], list[tuple[np.ndarray, np.ndarray]]]:
    """The leaves of a shard, and the whole trie's counts of the orders below its depth for the contexts it needs."""
    leaves = trie.filter(ending(shard.depth).isin(list(shard.ends))) if shard.depth else trie
    lower = []
    for k in range(shard.depth):
        some = trie.filter(ending(k).isin(shard.suffixes(k))) if k else trie
        lower.append(arrays(some.groupBy(F.col("key").bitwiseAND((1 << WIDTH * (k + 1)) - 1).alias("key")).agg(F.sum("n").alias("n"))))
    return arrays(leaves), lower


def score_corpus(df: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", *, order: int = 4, shard_entries: int = 4_000_000, head_words: int = 2_000_000) -> DataFrame:
    """``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row; ``training`` tells which rows teach."""
    scratch = Scratch(df.sparkSession, "lm")
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(training, F.lit(False)).alias("train"), F.col(text_col).cast("string").alias("text"))
    counts = scratch.save(count_corpus(docs.filter("train"), "text", order))
    words, trie = counts.filter("kind = 0"), counts.filter("kind = 1")
    # a row for each power of two, so that the head's least count is known before any word is collected
    sizes = {r.e: (r.words, r.tokens) for r in words.groupBy(F.floor(F.log2("n")).cast("int").alias("e")).agg(F.count("*").alias("words"), F.sum("n").alias("tokens")).collect()}
    texts = counts.filter("kind = 2").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    total, distinct = sum(t for _, t in sizes.values()) + texts, sum(w for w, _ in sizes.values()) + (texts > 0)
    least = next((e for e in range(64) if sum(w for k, (w, _) in sizes.items() if k >= e) <= head_words), 64)
    whole = all(e >= least for e in sizes)
    spark = df.sparkSession
    norm = math.log10(total + 0.5 * (distinct + 1)) if total else math.log10(0.5)
    head = spark.sparkContext.broadcast(arrays(words.filter(F.col("n") >= F.lit(2**least))))
    shards = trie_shards(trie, shard_entries, order)
    if len(shards) > 1:
        docs = scratch.save(docs)  # so that each pass numbers the rows alike
    scored = None
    for k, shard in enumerate(shards):
        shared = spark.sparkContext.broadcast((*shard_arrays(trie, shard), shard))
        part = scratch.save(score_pass(docs, order, head if k == 0 else None, shared, norm, texts, whole))
        shared.destroy()
        scored = part if scored is None else scored.unionByName(part)
    # the first pass has the words; further ones only add their positions
    if len(shards) > 1:
        more = scored.groupBy("part", "row").agg(F.sum("score").alias("all"))
        scored = scored.filter(F.col("n_tokens").isNotNull()).join(more, ["part", "row"]).withColumn("score", F.col("all")).drop("all")
    if not whole:
        rest = words.filter(F.col("n") < F.lit(2**least)).select("key", "n")
        tail = scored.select("part", "row", F.explode(F.arrays_zip("tail", "times")).alias("t")).select("part", "row", F.col("t.tail").alias("key"), F.col("t.times").alias("times"))
        tail = tail.join(rest, "key", "left").groupBy("part", "row")
        c = F.coalesce("n", F.lit(0))
        tail = tail.agg(F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("known"), F.sum(F.col("times") * (F.log10(c + 0.5) - F.lit(norm))).alias("base"))
        scored = scored.join(tail, ["part", "row"], "left")
        scored = scored.withColumn("n_known", F.col("n_known") + F.coalesce("known", F.lit(0))).withColumn("base_score", F.col("base_score") + F.coalesce("base", F.lit(0.0)))
    return scored.select(F.col("id").alias(id_col), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def score_pass(docs: DataFrame, order: int, head, shared, norm: float, texts: int, whole: bool) -> DataFrame:
    """One pass over the texts for a trie shard; with ``head``, also the words: sums over known ones, and the hashes of the rest."""
    fields = [
        ("part", T.IntegerType()), ("row", T.LongType()), ("id", docs.schema["id"].dataType), ("train", T.BooleanType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType()),
        ("tail", T.ArrayType(T.LongType())), ("times", T.ArrayType(T.LongType())),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves, lower, shard = shared.value
        model, part, row = Model(*leaves, order, lower), TaskContext.get().partitionId(), 0
        if head is not None:
            index = Index(head.value[0])
            logs = np.log10(head.value[1] + 0.5) - norm
            end = math.log10(texts + 0.5) - norm
        for batch in batches:
            for first, data in groups(batch.column("text").to_pylist()):
                n = len(data)
                key, at = windows(data, order)
                cost, own = np.zeros(len(key)), np.flatnonzero(shard.own(key))
                cost[own] = model.score(key[own])
                score = np.add.reduceat(cost, at)
                cols = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(row, row + n)), batch.column("id").slice(first, n), batch.column("train").slice(first, n)]
                if head is None:
                    none = pa.nulls(n, pa.int64())
                    cols += [none, none, pa.nulls(n, pa.float64()), pa.array(score), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))]
                else:
                    h, owner = word_hashes(data)
                    found = index.find(h)
                    hit = found >= 0
                    size = np.bincount(owner, minlength=n) + 1
                    known = np.bincount(owner[hit], minlength=n) + (texts > 0)
                    base = np.bincount(owner[hit], logs[found[hit]], n) + end
                    miss_h, miss_o = h[~hit], owner[~hit]
                    if whole:
                        base += np.bincount(miss_o, minlength=n) * (math.log10(0.5) - norm)
                        lists = [pa.nulls(n, pa.list_(pa.int64()))] * 2
                    else:
                        by = np.lexsort((miss_h, miss_o))
                        miss_h, miss_o = miss_h[by], miss_o[by]
                        new = np.flatnonzero(np.concatenate([[True], (miss_h[1:] != miss_h[:-1]) | (miss_o[1:] != miss_o[:-1])])) if len(by) else by
                        times = np.diff(np.append(new, len(by)))
                        offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(miss_o[new], minlength=n))]).astype(np.int32))
                        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (miss_h[new].view(np.int64), times.astype(np.int64))]
                    cols += [pa.array(size.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score), *lists]
                row += n
                yield pa.RecordBatch.from_arrays(cols, names=[f for f, _ in fields])

    return docs.mapInArrow(run, T.StructType([T.StructField(n, t) for n, t in fields]))
