"""Texts stored as MPEG audio in a media column, and features of such a column.

Defined results: a null text is an empty one; an empty text is stored as one
frame of bytes 255; equal texts give equal media and equal features; every row
gives one row. A null or broken medium gives a stream without frames. Other
columns of the input are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from larkspur.llm import mpeg_audio
from larkspur.llm.frames import map_batches, sha256, struct, utf8
from larkspur.llm.storage import sized, written


def store(df: DataFrame, text: str = "text", keep: list[str] = ("doc_id",)) -> DataFrame:
    """keep, media (binary), written to the shared folder."""

    def run(batch: pa.RecordBatch) -> dict:
        media = [mpeg_audio.write(mpeg_audio.padded(t), len(t)) for t in utf8(batch.column(text))]
        return {c: batch.column(c) for c in keep} | {"media": media}

    return written(sized(map_batches(df.select(*keep, text), run, struct(df, list(keep), media=T.BinaryType())), df), "media")


def features(df: DataFrame, media: str = "media", keep: list[str] = ("doc_id",)) -> DataFrame:
    """keep, and what a scan of each medium shows: frames, samples, rate, seek offsets, checksums, tables and payload digests."""
    more = {
        "n_bytes": T.LongType(), "payload_bytes": T.LongType(), "payload_sha256": T.StringType(), "tail_crc32": T.LongType(), "media_bytes": T.LongType(), "media_sha256": T.StringType(),
        "n_frames": T.LongType(), "n_samples": T.LongType(), "sample_rate": T.IntegerType(), "bad_checksums": T.LongType(), "skipped_bytes": T.LongType(), "table_frames": T.LongType(), "frame_offsets": T.ArrayType(T.LongType()),
    }

    def run(batch: pa.RecordBatch) -> dict:
        rows: dict[str, list] = {k: [] for k in more}
        for data in batch.column(media).to_pylist():
            data = data or b""
            s = mpeg_audio.scan(data)
            n = s.tags.get("n_bytes", "")
            values = (
                int(n) if n.isdigit() else None, len(s.payload), sha256(s.payload), zlib.crc32(s.payload[-32:]), len(data), sha256(data),
                len(s.offsets), s.samples, s.rate, s.wrong, s.skipped, s.table.get("frames"), s.offsets,
            )
            for k, v in zip(rows, values):
                rows[k].append(v)
        offsets = np.cumsum([0] + [len(x) for x in rows["frame_offsets"]])
        rows["frame_offsets"] = pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), pa.array(np.concatenate([*rows["frame_offsets"], np.empty(0, dtype=np.int64)])))
        return {c: batch.column(c) for c in keep} | rows

    return map_batches(df.select(*keep, media), run, struct(df, list(keep), **more))
