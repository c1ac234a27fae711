"""One row per value of a packed field, with its place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernmill.functions.packed import split_arrow
from quernmill.operators.names import fresh


def split_packed(df: DataFrame, field: str, keys: list[str], *, value: str = "value", pos: str = "pos") -> DataFrame:
    """Keys, place from 1 and value of each value packed in `field`.

    Null, empty and blank fields give no row; repeated values and rows stay; columns other
    than `keys` and `field` are not read. The work is one narrow pass over Arrow buffers: no
    shuffle. Where a key has the name of `pos` or `value`, that gets underscores appended.
    """
    pos = fresh(pos, keys)
    value = fresh(value, [*keys, pos])
    picked = df.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{field}`").cast("string").alias("__packed"))
    schema = T.StructType([*picked.schema.fields[:-1], T.StructField(pos, T.LongType()), T.StructField(value, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = split_arrow(batch.column(batch.num_columns - 1))
            sizes = np.diff(lists.offsets.to_numpy())
            parents = np.repeat(np.arange(len(lists)), sizes)
            places = np.arange(len(parents)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
            columns = [batch.column(k).take(pa.array(parents)) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(places, pa.int64()), lists.flatten()], [*keys, pos, value])

    return picked.where(F.col("__packed") != "").mapInArrow(run, schema)
