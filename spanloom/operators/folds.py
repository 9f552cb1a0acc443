"""Sequential folds over the rows of a key in order, many keys in one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

Fold = Callable[..., list[tuple]]


def fold_groups(df: DataFrame, key: str, order: list[str], values: list[str], fold: Fold, fields: list[tuple[str, T.DataType]]) -> DataFrame:
    """``(key, *fields)``: the rows that ``fold`` makes of the lists of a key's values, in order.

    One exchange on the key, or none if a window over it comes before.  A row
    number both sorts the rows and tells where a key begins; a task holds the
    rows of one key and one Arrow batch at a time.
    """
    names, kinds = [key, *(f for f, _ in fields)], [df.schema[key].dataType, *(t for _, t in fields)]
    arrow = [to_arrow_type(t) for t in kinds]
    first = (F.row_number().over(Window.partitionBy(key).orderBy(*order)) == 1).alias("_first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, open_ = None, [[] for _ in values], False

        def close(out: list[list]) -> None:
            for row in fold(*held):
                for column, value in zip(out, (now, *row), strict=True):
                    column.append(value)

        for batch in batches:
            firsts, keys, *columns = (c.to_pylist() for c in batch.columns)
            out: list[list] = [[] for _ in names]
            begins = [k for k, f in enumerate(firsts) if f]
            for h, c in zip(held, columns, strict=True):
                h += c[: begins[0] if begins else len(c)]
            # none in a batch that a long key fills
            for a, b in pairwise([*begins, len(keys)]):
                if open_:
                    close(out)
                now, open_, held = keys[a], True, [c[a:b] for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, arrow, strict=True)], names=names)
        if open_:
            out = [[] for _ in names]
            close(out)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, arrow, strict=True)], names=names)

    return df.select(first, key, *values).mapInArrow(run, T.StructType([T.StructField(n, t) for n, t in zip(names, kinds, strict=True)]))
