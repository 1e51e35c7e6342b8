"""Small helpers for running Arrow functions over DataFrames."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

BATCH_ROWS = 2048  # rows put into one output batch at most
BATCH_BYTES = 8 << 20  # and bytes, but for a single row that is larger


def slices(batch: pa.RecordBatch, rows: int = BATCH_ROWS, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows, each within rows and bytes (or a single row)."""
    step = rows
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        if part.nbytes <= most or part.num_rows == 1:
            yield part
        else:
            yield from slices(part, max(1, part.num_rows // 2), most)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict] | dict], schema: T.StructType) -> DataFrame:
    """mapInArrow for a function from a batch of bounded size to a dict of columns, or to several."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                made = fn(part)
                for columns in [made] if isinstance(made, dict) else made:
                    yield pa.RecordBatch.from_arrays([_array(columns[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def _array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def struct(df: DataFrame, keep: list[str], **more: T.DataType) -> T.StructType:
    """A schema of columns of df and new ones."""
    return T.StructType([T.StructField(c, df.schema[c].dataType) for c in keep] + [T.StructField(k, v) for k, v in more.items()])


def sha256(data) -> str:
    return hashlib.sha256(data).hexdigest()


def utf8(column: pa.Array) -> list[memoryview]:
    """The UTF-8 bytes of each text, without copies; a null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return []
    _, offsets, data = column.buffers()
    at = memoryview(offsets).cast("q")[column.offset : column.offset + n + 1]
    raw = memoryview(data) if data is not None else memoryview(b"")
    return [raw[a:b] for a, b in zip(at[:-1], at[1:])]
