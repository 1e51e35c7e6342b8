"""SentencePiece encoding and decoding of a text column.

Defined results: a null text counts as empty; an empty text has the begin and
end ids alone and decodes to an empty text; every input row gives one output
row, repeated rows repeated ones; other columns of the input, whatever their
names, are not read. Very long texts are encoded whole, one at a time.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from larkspur.llm.frames import map_batches, sha256, struct
from larkspur.llm.piece_tokenizer import PieceModel, check_model
from larkspur.llm.storage import sized

_models: dict[str, PieceModel] = {}


def _model(data: bytes) -> PieceModel:
    """One model (and its memo of words) per Python worker, for all its tasks."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _models:
        _models.clear()
        _models[key] = PieceModel(data)
    return _models[key]


def read_model(path: str) -> bytes:
    """A model file's bytes, read by the driver and sent with the tasks; files over 16 MB are refused."""
    with open(path, "rb") as f:
        data = f.read((16 << 20) + 1)
    if len(data) > 16 << 20:
        raise ValueError("a model file of over 16 MB")
    check_model(data)
    return data


def encode(df: DataFrame, model_path: str, text: str = "text", keep: list[str] = ("doc_id",)) -> DataFrame:
    """keep, ids (array of int): the ids of each text."""
    model = read_model(model_path)

    def run(batch: pa.RecordBatch) -> dict:
        ids = list(_model(model).encode(batch.column(text)))
        return {c: batch.column(c) for c in keep} | {"ids": pa.array([i.astype("int32") for i in ids], type=pa.list_(pa.int32()))}

    return map_batches(df.select(*keep, text), run, struct(df, list(keep), ids=T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, model_path: str, ids: str = "ids", keep: list[str] = ("doc_id",)) -> DataFrame:
    """keep, text: the text of each list of ids; a null list is an empty one."""
    model = read_model(model_path)

    def run(batch: pa.RecordBatch) -> dict:
        import numpy as np

        own = _model(model)
        texts = [own.decode(np.array(x or [], dtype=np.int64)) for x in batch.column(ids).to_pylist()]
        return {c: batch.column(c) for c in keep} | {"text": texts}

    return map_batches(df.select(*keep, ids), run, struct(df, list(keep), text=T.StringType()))


def round_trip_digests(df: DataFrame, model_path: str, text: str = "text", keep: list[str] = ("doc_id",)) -> DataFrame:
    """keep, n_tokens, ids_sha256 (of little-endian 32-bit ids), decoded_sha256: encode and decode in one pass, without a shuffle."""
    model = read_model(model_path)

    def run(batch: pa.RecordBatch) -> dict:
        own = _model(model)
        n, digest, decoded = [], [], []
        for ids in own.encode(batch.column(text)):
            n.append(len(ids))
            digest.append(sha256(ids.astype("<u4").tobytes()))
            decoded.append(sha256(own.decode(ids).encode("utf-8")))
        return {c: batch.column(c) for c in keep} | {"n_tokens": n, "ids_sha256": digest, "decoded_sha256": decoded}

    more = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    return sized(map_batches(df.select(*keep, text), run, struct(df, list(keep), **more)), df)
