"""Ordered folds inside a key, for results that depend on earlier decisions of the same group."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

ROWS_OUT = 20_000


def fold_by_key(df: DataFrame, keys: list[str], order: list[str], fold: Callable[[Iterator[dict]], Iterable[dict]], schema: str) -> DataFrame:
    """fold() over the rows of each key in order: it is given an iterator over them and returns or yields rows.

    Rows are dealt by key and sorted by Spark; a task then streams its keys by. A fold that yields as it reads holds no
    more of a key than its own state.
    """
    kind = to_arrow_schema(StructType.fromDDL(schema))
    of = itemgetter(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, out = (row for batch in batches for row in batch.to_pylist()), []
        for _, own in groupby(rows, key=of):
            for row in fold(own):
                out.append(row)
                if len(out) >= ROWS_OUT:
                    yield pa.RecordBatch.from_pylist(out, schema=kind)
                    out = []
        yield pa.RecordBatch.from_pylist(out, schema=kind)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
