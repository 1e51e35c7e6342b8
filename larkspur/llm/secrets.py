"""Credentials in texts, told apart by who holds them across the corpus.

Candidates are the base kinds (assign, access, hex) and long high-entropy
tokens outside them. Each candidate's value is hashed; over the whole corpus
the distinct repositories and owners of each hash are counted. A value that
COPIED_OWNERS owners or more hold, or COPIED_REPOSITORIES repositories or more
(a template that one owner copies about), is a copied example; one that a
single owner holds in fewer repositories and whose characters look random is a
live-looking credential of that owner; what lies between is shared.
High-entropy tokens become spans of kind ``owned`` where they are live-looking;
base spans stay in any case.

Values leave the scan as hashes only. Defined results: a null text is an empty
one; spans count code points; a null owner or repository counts as one of its
own; each row gives one row, and repeated rows count once as holders. Other
columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.frames import map_batches, sha256, utf8
from larkspur.llm.storage import few, gathered, sized, written

KINDS = ("assign", "access", "hex", "owned")
LEAST = {"assign": 6, "access": 20, "hex": 24, "owned": 28}
COPIED_OWNERS = 3
COPIED_REPOSITORIES = 4
LIVE_ENTROPY = 3.0  # bits a character

_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_WORDS = re.compile(rb"p(?=assw)|s(?=ecret)|t(?=oken)|a(?=pi_?key)")  # one byte each: words may overlap
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{24,}")  # a shorter run fails, and runs don't overlap
_TOKEN = re.compile(rb"[A-Za-z0-9+/_-]{28,}")


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[list(chars)] = True
    return t


_TOKEN_BYTE = _table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")


def entropy(value: bytes) -> float:
    return -sum(c / len(value) * log2(c / len(value)) for c in Counter(value).values()) if value else 0.0


def _assigned(data: bytes) -> list[tuple[int, int, bytes]]:
    """Matches from left to right; each begins at one of a few words, which are found in a lower-case copy."""
    out, at = [], 0
    for word in _WORDS.finditer(data.lower()):
        if word.start() >= at and (m := _ASSIGN.match(data, word.start())):
            at = m.end()
            if len(m[2]) >= LEAST["assign"]:
                out.append((m.start(), m.end(), m[2]))
    return out


def candidates(data: bytes) -> list[tuple[int, int, int, bytes]]:
    """(start, kind, end, value) in bytes; the kinds are indexes into KINDS."""
    found = []
    if b"=" in data or b":" in data:
        found += [(a, 0, b, v) for a, b, v in _assigned(data)]
    if b"AKIA" in data:
        found += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(data) if len(m[0]) >= LEAST["access"]]
    view = np.frombuffer(data, dtype=np.uint8)
    if len(view) >= LEAST["hex"]:  # regular expressions only where a run is long enough
        out = np.flatnonzero(~_TOKEN_BYTE[view])
        edges = np.concatenate(([-1], out, [len(view)]))
        for k in np.flatnonzero(np.diff(edges) > LEAST["hex"]).tolist():
            a, b = int(edges[k]) + 1, int(edges[k + 1])
            found += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(data, a, b)]
            found += [(m.start(), 3, m.end(), m[0]) for m in _TOKEN.finditer(data, a, b) if _random(m[0])]
    base = [(a, b) for a, kind, b, _ in found if kind < 3]
    return sorted(x for x in found if x[1] < 3 or not any(a < x[2] and x[0] < b for a, b in base))


def _random(value: bytes) -> bool:
    """A token of mixed letters and digits, as generators make them."""
    return bool(re.search(rb"[0-9]", value) and re.search(rb"[A-Z]", value) and re.search(rb"[a-z]", value)) and entropy(value) >= 4.0


_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.LongType())])
_FOUND = T.StructType([*_SPAN.fields, T.StructField("value", T.BinaryType()), T.StructField("live", T.BooleanType())])


def scan_texts(df: DataFrame, owner: Column, repository: Column, key: str, text: str) -> DataFrame:
    """key, owner, repository, n_assign, n_access, n_hex, base_sha256, found: one row for each row."""
    schema = T.StructType([
        T.StructField("key", df.schema[key].dataType), T.StructField("owner", T.LongType()), T.StructField("repository", T.LongType()),
        T.StructField("n_assign", T.LongType()), T.StructField("n_access", T.LongType()), T.StructField("n_hex", T.LongType()),
        T.StructField("base_sha256", T.StringType()), T.StructField("found", T.ArrayType(_FOUND)),
    ])
    nothing = sha256(b"")

    def run(batch: pa.RecordBatch) -> dict:
        counts, digests, all_found = ([], [], []), [], []
        for raw in utf8(batch.column("text")):
            data = bytes(raw)
            found = candidates(data)
            if found and not data.isascii():
                points = np.concatenate(([0], np.cumsum((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80)))
                found = [(int(points[a]), k, int(points[b]), v) for a, k, b, v in found]
            for k, n in enumerate(counts):
                n.append(sum(x[1] == k for x in found))
            base = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in found if k < 3)
            digests.append(sha256(base.encode()) if base else nothing)
            all_found.append([{"start": a, "kind": k, "end": b, "value": hashlib.sha256(v).digest()[:16], "live": entropy(v) >= LIVE_ENTROPY} for a, k, b, v in found])
        return {c: batch.column(c) for c in ("key", "owner", "repository")} | dict(zip(("n_assign", "n_access", "n_hex"), counts)) | {"base_sha256": digests, "found": all_found}

    # owners and repositories are only counted: their hashes do
    return map_batches(df.select(F.col(key).alias("key"), F.xxhash64(owner).alias("owner"), F.xxhash64(owner, repository).alias("repository"), F.col(text).alias("text")), run, schema)


def ownership(found: DataFrame) -> DataFrame:
    """value, n_repositories, n_owners. found: value, owner, repository; copies within a holder are merged before the shuffle."""
    held = found.select("value", "owner", "repository").distinct()
    by_owner = held.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("n"))
    return by_owner.groupBy("value").agg(F.sum("n").alias("n_repositories"), F.count(F.lit(1)).alias("n_owners"))


def scan(df: DataFrame, owner: str | Column = "owner", repository: str | Column = "repository", key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied.

    spans are all spans; n_live and n_copied count those whose values are
    live-looking and of one owner, and widely copied examples.
    """
    owner, repository = (F.col(c) if isinstance(c, str) else c for c in (owner, repository))
    rows = written(sized(scan_texts(df, owner, repository, key, text), df).withColumn("row", F.monotonically_increasing_id()), "secrets")
    found = rows.where(F.size("found") > 0).select("row", "owner", "repository", F.explode("found").alias("f")).select("row", "owner", "repository", "f.*")
    classes = few(written(gathered(ownership(found)), "secret-owners"), 96)
    copied = (F.col("n_owners") >= COPIED_OWNERS) | (F.col("n_repositories") >= COPIED_REPOSITORIES)
    live = (F.col("n_owners") == 1) & F.col("live") & ~copied
    shown = F.when((F.col("kind") < 3) | live, F.struct("start", "kind", "end"))
    told = found.drop("owner", "repository").join(classes, "value").groupBy("row").agg(
        F.array_sort(F.collect_list(shown)).alias("shown"), F.count_if(live).alias("n_live"), F.count_if(copied).alias("n_copied")
    )
    names = F.array(*[F.lit(k) for k in KINDS])
    spans = F.array_join(F.transform("shown", lambda s: F.concat(F.element_at(names, s["kind"] + 1), F.lit(":"), s["start"], F.lit(":"), s["end"])), ",")
    zero = F.lit(0).cast("long")
    return rows.drop("found", "owner", "repository").join(told, "row", "left").select(
        F.col("key").alias(key), "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce(spans, F.lit("")).alias("spans"), F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_copied", zero).alias("n_copied")
    )
