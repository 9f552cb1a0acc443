"""Word timing: uniform within a segment, or across its speech spans by largest remainder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """The words of a text between white space of any kind."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def uniform_words(df: DataFrame, text: str = "text", start: str = "start", end: str = "end") -> DataFrame:
    """A row for each word: ``start + i * d`` to ``start + (i + 1) * d``, d the segment's length over its words; not a running sum."""
    held = df.withColumn("_w", words(F.col(text)))
    each = held.select(*df.columns, F.size("_w").alias("_n"), F.posexplode("_w").alias("word_index", "word"))
    d = F.greatest(F.lit(0.0), F.col(end) - F.col(start)) / F.col("_n")
    return each.withColumn("word_start", F.col(start) + F.col("word_index") * d).withColumn("word_end", F.col(start) + (F.col("word_index") + 1) * d).drop("_n")


def largest_remainder(df: DataFrame, keys: list[str], total: str, weight: str, index: str) -> DataFrame:
    """``df`` with ``share``: ``total`` dealt out over a key's rows in proportion to ``weight``.

    Whole parts first, then one each by fraction, weight (both descending) and
    index; all zeros without weight.
    """
    w = Window.partitionBy(*keys)
    sum_ = F.sum(weight).over(w)
    exact = F.when(sum_ > 0, F.col(total) * F.col(weight) / sum_).otherwise(F.lit(0.0))
    held = df.withColumn("_x", exact).withColumn("_f", F.floor("_x")).withColumn("_r", F.when(sum_ > 0, F.col(total) - F.sum("_f").over(w)).otherwise(0))
    rank = F.row_number().over(w.orderBy(F.desc(F.col("_x") - F.col("_f")), F.desc(weight), index))
    return held.withColumn("share", (F.col("_f") + F.when(rank <= F.col("_r"), 1).otherwise(0)).cast("long")).drop("_x", "_f", "_r")


def words_across_spans(spans: DataFrame, keys: list[str], text: str = "text", start: str = "start", end: str = "end", index: str = "span_index") -> DataFrame:
    """``keys, word_index, word, word_start, word_end``: a segment's words dealt over its speech spans, uniform inside each.

    ``spans`` has a row for each span, with the segment's text.
    """
    held = spans.filter(F.col(end) > F.col(start)).withColumn("_w", words(F.col(text))).withColumn("_n", F.size("_w")).withColumn("_d", F.col(end) - F.col(start))
    dealt = largest_remainder(held, keys, "_n", "_d", index)
    before = Window.partitionBy(*keys).orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("_b", F.coalesce(F.sum("share").over(before), F.lit(0)).cast("int")).filter("share > 0")
    each = placed.select(*keys, start, "_d", "share", "_b", F.posexplode(F.slice("_w", F.col("_b") + 1, F.col("share").cast("int"))).alias("_i", "word"))
    d = F.col("_d") / F.col("share")
    return each.select(*keys, (F.col("_b") + F.col("_i")).alias("word_index"), "word", (F.col(start) + F.col("_i") * d).alias("word_start"), (F.col(start) + (F.col("_i") + 1) * d).alias("word_end"))


def star_interleaved(tokens: Column) -> Column:
    """Each token after a ``<star>``."""
    return F.flatten(F.transform(tokens, lambda t: F.array(F.lit("<star>"), t)))
