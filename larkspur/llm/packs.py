"""Sorted 48-bit keys as compact bytes, dealt into buckets by value."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from larkspur.llm.storage import FILE_BYTES, estimated_bytes


def pack48(keys: np.ndarray) -> bytes:
    """48-bit keys as six planes of bytes: sorted keys' high planes compress well."""
    return keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].T.tobytes()


def unpack48(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(6, -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, 2:] = planes.T
    return out.view(">u8").reshape(-1).astype(np.uint64)


def bucket_edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket of sorted 48-bit keys begins, and the end."""
    edges = np.searchsorted(keys, np.array([(b << 48) // buckets for b in range(buckets)], dtype=np.uint64))
    return np.append(edges, len(keys))


def buckets_for(df: DataFrame) -> int:
    """Value ranges for the keys of df's texts: one for each shuffle partition, or more where a group would take too much memory."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), (estimated_bytes(df) or 0) // FILE_BYTES)
