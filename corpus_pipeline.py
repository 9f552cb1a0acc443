"""A corpus pipeline of five stages, each written as Parquet before the next one reads it.

The stages are, in order: toxicity (documents it rejects go), line dedup,
SimHash near-dedup (the document with the least id of each group stays),
benchmark decontamination (documents that hold a test item go) and best-fit
packing (a row for each packed piece).  Rows that share an id are one document.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import decontaminate, linededup, packing, simhash, toxicity
from spanloom.llm.queries import label_table
from spanloom.sources.scratch import Scratch
from spanloom.sources.tables import table


def aside(docs: DataFrame, *names: str) -> DataFrame:
    """``docs`` with those of its columns renamed that an operator would replace."""
    return docs.select(*(F.col(c).alias(f"\x00{c}") if c.lower() in names else c for c in docs.columns))


def back(df: DataFrame, docs: DataFrame, *names: str) -> DataFrame:
    """The columns of ``docs``, by their own names, after :func:`aside`."""
    return df.select(*(F.col(f"\x00{c}").alias(c) if c.lower() in names else c for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the chain doesn't reject; null and empty texts are judged by its bias, equal rows alike."""
    made = ("toxic", "p_toxic", "p_low_quality")
    judged = toxicity.judge(aside(docs, *made), label_table(spark, sf_dir), ["low_quality", "toxic"], reject="toxic", keep_text=True)
    return back(judged.filter(~F.col("toxic")), docs, *made)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their later copies of repeated line runs, and ``n_chars`` as it is then; equal rows are one document."""
    cut = linededup.dedup_lines(aside(docs, "deleted"))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return back(cut, docs, "deleted")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near copies; equal ids are one document, null ids stay, empty texts are copies of each other."""
    gone = simhash.near_duplicates(docs.select("doc_id", "text")).filter("doc_id != component_id").select(F.col("doc_id").alias("\x00gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("\x00gone"), "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no test item, edited or not; null and empty texts hold none."""
    found = decontaminate.with_leaks(aside(docs, "leaks"), table(spark, sf_dir, "benchmark"))
    return back(found.filter(F.size("leaks") == 0), docs, "leaks")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each packed piece of each document; null and empty texts are an end token."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: No SQL: model fitting, hashing of token ids and packing have no DuckDB form; tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: the packed pieces."""
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for _, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return docs
