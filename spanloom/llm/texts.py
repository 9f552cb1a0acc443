"""Row-wise functions of a text column, by Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def others(df: DataFrame, *names: str) -> list[str]:
    """The columns of ``df`` but those named, whatever their case, as Spark tells names apart."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


Make = Callable[[], Callable[[list[str | None]], list[pa.Array]]]


def with_text_columns(df: DataFrame, text_col: str, fields: list[T.StructField], make: Make, keep_text: bool) -> DataFrame:
    """``df`` with the columns ``fields``, which ``make()`` returns a function for, called with each batch's texts.

    ``make`` runs once in each task.  Columns of those names are replaced; the
    text goes unless ``keep_text``.
    """
    names = [f.name for f in fields]
    keep = others(df, *names, text_col)
    last = None if keep_text else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = make()
        for batch in batches:
            out = columns(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], *out], names=[*batch.schema.names[:last], *names])

    source = df.select(*keep, F.col(text_col).cast("string").alias(text_col))
    return source.mapInArrow(run, T.StructType([*source.schema.fields[:last], *fields]))
