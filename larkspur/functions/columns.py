"""Tables that many tasks read whole, in one order: written once to the shared folder, read in batches by pyarrow.

What a task would otherwise get by a shuffle of one copy for each task, it
reads here: the shuffle's disk goes, and a task holds only the columns it keeps.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

BATCH = 65_536


@dataclass
class Stored:
    files: list[str]
    rows: int

    def batches(self, *columns: str) -> Iterator[pa.RecordBatch]:
        """In executors."""
        import pyarrow.fs
        import pyarrow.parquet as pq

        for name in self.files:
            if urlparse(name).scheme in ("", "file"):
                fs, path = pyarrow.fs.LocalFileSystem(), unquote(urlparse(name).path)
            else:
                fs, path = pyarrow.fs.FileSystem.from_uri(name)
            with fs.open_input_file(path) as f:
                yield from pq.ParquetFile(f).iter_batches(BATCH, columns=list(columns), use_threads=False)

    def column(self, name: str, kind: type = np.float64) -> np.ndarray:
        """One column; nulls of floats are NaN."""
        out, at = np.empty(self.rows, kind), 0
        for batch in self.batches(name):
            values = batch.column(0).to_numpy(zero_copy_only=False)
            out[at : at + len(values)] = values
            at += len(values)
        return out


class stored:
    """A context that holds df, sorted, in the shared folder."""

    def __init__(self, df: DataFrame, *order: str | Column):
        from larkspur.operators.splits import checkpoint_dir

        self.df, self.order, self.spark = df, order, df.sparkSession
        self.path = f"{checkpoint_dir(self.spark)}/columns-{uuid.uuid4().hex}"

    def __enter__(self) -> Stored:
        self.df.orderBy(*self.order).write.option("compression", "zstd").parquet(self.path)
        made = self.spark.read.schema(self.df.schema).parquet(self.path)
        return Stored(sorted(made.inputFiles()), made.count())

    def __exit__(self, *_) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
