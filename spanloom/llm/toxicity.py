"""Toxicity by classifier chains.

Categories are predicted in a fixed order.  Each link is a logistic model over
the presence of words and over the probabilities of the categories before it.
Links are trained with out-of-fold predictions of the earlier links, so that
they learn how far those can be trusted on texts that were not trained on.

The models are fitted on the driver from at most ``sample`` labelled rows,
taken by hash of their id; each sampled text is sent there as the 64-bit
hashes of its distinct words.  A link looks at the ``features`` words of the
sample whose frequency differs most between its classes, by ``LEAST_SCORE``
standard deviations or more.  Scoring covers all rows and whole texts.

Defined results: a null or empty text has no words and gets the bias alone;
labels that are null are left out; of several
texts with one labelled id, that with the least sum of word hashes is sampled; a category with one class only has that
class's probability; without labelled rows each probability is zero.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lm import groups, word_hashes
from .texts import with_text_columns

#: Standard deviations by which a word's frequency must differ between the classes.
LEAST_SCORE = 2.5
#: A-Z lower-cased, other ASCII but letters turned to blanks.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


@dataclass
class Words:
    """The distinct words of ``n`` texts: each pair of a text's number and a word's hash once, in order."""

    owner: np.ndarray
    word: np.ndarray
    n: int

    @classmethod
    def of(cls, texts: list[bytes]) -> Words:
        """Words are runs of ASCII letters and non-ASCII characters."""
        h, owner = word_hashes([t.translate(LETTERS) for t in texts])
        by = np.lexsort((h, owner))
        h, owner = h[by], owner[by]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]) if len(h) else np.zeros(0, bool)
        return cls(owner[new], h[new], len(texts))

    def rows(self, some: np.ndarray) -> Words:
        """The texts of the given numbers, which are ascending, numbered anew."""
        place = np.full(self.n, -1, np.int32)
        place[some] = np.arange(len(some))
        kept = place[self.owner] >= 0
        return Words(place[self.owner[kept]], self.word[kept], len(some))


@dataclass
class Link:
    """One category's model: word hashes in order with their weights, weights of the earlier probabilities, bias."""

    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    earlier: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -50.0


def logistic(x: np.ndarray, y: np.ndarray, shrink: np.ndarray, steps: int = 20) -> np.ndarray:
    """Newton's method for logistic regression with a ridge penalty of its own for each column."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink + 1e-9)
        move = np.linalg.solve(hess, x.T @ (y - p) - shrink * w)
        w += move * min(1, 4 / max(1e-9, np.abs(move).max()))
        if np.abs(move).max() < 1e-4:
            break
    return w


def fit_link(docs: Words, y: np.ndarray, earlier: np.ndarray, features: int, ridge: float) -> Link:
    """A link over the words whose frequency differs most between the classes."""
    pos = int(y.sum())
    if pos in (0, len(y)):
        return Link(earlier=np.zeros(earlier.shape[1]), bias=50.0 if pos and len(y) else -50.0)
    names, ids = np.unique(docs.word, return_inverse=True)
    n, a = np.bincount(ids, minlength=len(names)), np.bincount(ids[y[docs.owner] > 0], minlength=len(names))
    share = pos / len(y)
    score = np.abs(a - n * share) / np.sqrt(n * share * (1 - share) + 1)
    # a word must differ by more than chance, or few labels would be learnt by heart; one text's word says nothing about others
    score[n < 2] = 0
    chosen = np.sort(np.argsort(-score, kind="stable")[: min(features, int((score >= LEAST_SCORE).sum()))])
    column = np.full(len(names), -1)
    column[chosen] = np.arange(len(chosen))
    x = np.zeros((docs.n, len(chosen) + earlier.shape[1] + 1))
    kept = column[ids] >= 0
    x[docs.owner[kept], column[ids[kept]]] = 1
    x[:, len(chosen) : -1], x[:, -1] = earlier, 1
    # earlier probabilities are shrunk more than words: they hint, but mark no text alone
    w = logistic(x, y.astype(float), np.array([ridge] * len(chosen) + [1.0] * earlier.shape[1] + [1e-6]))
    return Link(names[chosen], w[: len(chosen)], w[len(chosen) : -1], float(w[-1]))


def predict(link: Link, docs: Words, earlier: np.ndarray) -> np.ndarray:
    """The category's probability for each text, rounded to 1e-9 so that the order of a sum can't show."""
    z = np.zeros(docs.n)
    if len(link.words):
        at = np.minimum(np.searchsorted(link.words, docs.word), len(link.words) - 1)
        hit = link.words[at] == docs.word
        z = np.bincount(docs.owner[hit], link.weights[at[hit]], docs.n)
    z = np.clip(z + (earlier @ link.earlier if earlier.shape[1] else 0) + link.bias, -40, 40)
    return np.round(1 / (1 + np.exp(-z)), 9)


def fit_chain(docs: Words, labels: np.ndarray, folds: int = 5, features: int = 200, ridge: float = 0.02) -> list[Link]:
    """A link for each column of ``labels``; rows are dealt to folds in turn."""
    fold = np.arange(docs.n) % folds
    seen, chain = np.zeros((docs.n, 0)), []
    for k in range(labels.shape[1]):
        y = labels[:, k]
        chain.append(fit_link(docs, y, seen, features, ridge))
        if k + 1 < labels.shape[1]:
            out = np.zeros(docs.n)
            for f in range(folds):
                on, off = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
                out[off] = predict(fit_link(docs.rows(on), y[on], seen[on], features, ridge), docs.rows(off), seen[off])
            seen = np.column_stack([seen, out])
    return chain


def predict_chain(chain: list[Link], docs: Words) -> np.ndarray:
    """Probabilities, a column for each category."""
    seen = np.zeros((docs.n, 0))
    for link in chain:
        seen = np.column_stack([seen, predict(link, docs, seen)])
    return seen


def train(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text", sample: int = 12_000) -> list[Link]:
    """Fit a chain on at most ``sample`` labelled texts; ``labels`` has ``id_col`` and a 0/1 column for each category."""
    names = [f"y{k}" for k in range(len(categories))]
    chosen = labels.select(F.col(id_col).alias("id"), *(F.col(c).cast("int").alias(n) for c, n in zip(categories, names, strict=True))).na.drop()
    chosen = chosen.groupBy("id").agg(*(F.max(n).alias(n) for n in names)).withColumn("k", F.xxhash64("id")).orderBy("k", "id").limit(sample)
    # at most ``sample`` short rows, so that no text is shuffled
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id").select("k", "text", *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in groups(batch.column("text").to_pylist()):
                found = Words.of(part)
                offsets = np.concatenate([[0], np.cumsum(np.bincount(found.owner, minlength=found.n))])
                some = batch.slice(first, found.n)
                total = np.zeros(found.n, np.uint64)
                np.add.at(total, found.owner, found.word)
                words = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(found.word.view(np.int64)))
                yield pa.RecordBatch.from_arrays([words, pa.array(total.view(np.int64)), some.column(0), *some.columns[2:]], names=["words", "total", "k", *names])

    each = texts.mapInArrow(run, "words array<long>, total long, k long, " + ", ".join(f"{n} int" for n in names))
    # an id in many rows is one row of the sample
    rows = each.groupBy("k", *names).agg(F.min_by("words", "total").alias("words")).toArrow().combine_chunks()
    flat = rows.column("words").combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.int64()))
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    sizes = np.diff(flat.offsets.to_numpy())
    word, owner = flat.flatten().to_numpy().view(np.uint64), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    # by id and content, so that the folds don't depend on the order of arrival
    total = np.zeros(len(sizes), np.uint64)
    np.add.at(total, owner, word)
    order = np.lexsort((total, rows.column("k").to_numpy())) if len(sizes) else np.zeros(0, np.int64)
    place = np.empty(len(sizes), np.int32)
    place[order] = np.arange(len(sizes))
    by = np.argsort(place[owner], kind="stable")
    y = np.column_stack([rows.column(n).to_numpy() for n in names])[order] if len(sizes) else np.zeros((0, len(names)), int)
    sample_words = Words(place[owner][by], word[by], len(sizes))
    del rows, flat, word, owner, by  # the driver holds the sample once while it fits
    return fit_chain(sample_words, y)


def score(df: DataFrame, chain: list[Link], categories: list[str], text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """``df`` with ``p_<category>`` for each category; columns of those names are replaced, and the text goes unless ``keep_text``."""
    shared = df.sparkSession.sparkContext.broadcast(chain)

    def make() -> Callable[[list[str | None]], list[pa.Array]]:
        def columns(texts: list[str | None]) -> list[pa.Array]:
            p = np.concatenate([np.zeros((0, len(categories))), *(predict_chain(shared.value, Words.of(part)) for _, part in groups(texts))])
            return [pa.array(p[:, k]) for k in range(len(categories))]

        return columns

    return with_text_columns(df, text_col, [T.StructField(f"p_{c}", T.DoubleType()) for c in categories], make, keep_text)


def judge(docs: DataFrame, labels: DataFrame, categories: list[str], reject: str, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", sample: int = 12_000, keep_text: bool = False) -> DataFrame:
    """``docs`` with each category's probability and ``toxic``: whether that of ``reject`` reaches the threshold."""
    chain = train(docs, labels, categories, id_col, text_col, sample)
    return score(docs, chain, categories, text_col, keep_text).withColumn("toxic", F.col(f"p_{reject}") >= threshold)
