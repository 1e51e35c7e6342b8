"""Approximate nearest neighbours by additive quantisation.

A vector is approximated by the sum of one code vector from each of several
full-dimensional codebooks. Codebooks are fit on a bounded sample (SAMPLE rows
with the smallest hashes of their ids): k-means on residuals first, then rounds
of beam-search encoding and a joint least-squares update of all codebooks.
Every row is encoded by beam search and kept with its codes and its norm. A
query scores all rows with lookup tables, ``norm - 2 * sum(table[code])``; the
rows whose score is within a margin of the best ones are reranked by the exact
distance in double precision on the original vectors. The margin is MARGIN
standard deviations of the score's error, which is measured on sample rows that
the codebooks aren't fit on; the number of reranked rows has no cap.

Vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part. A repeated id counts once, with its
nearest row (as a query: with its smallest vector). An empty table, or one
without queries, gives no rows. Queries are taken in blocks of bounded size,
each block against all rows; a task keeps ten rows for each query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.storage import Scratch, written

SAMPLE = 8192
BOOKS = 8
CODES = 256
BEAM = 4
ROUNDS = 3
MARGIN = 4.0
HELD_OUT = 8  # one of so many sample rows isn't fit on, and measures the error
PACK_QUERIES = 1024
PACK_ROWS = 8192  # of the index
GROUP_BYTES = 32 << 20  # of queries that a pass broadcasts
ROWS = 4096  # encoded or scored at once


@dataclass
class Quantizer:
    books: np.ndarray  # (books, codes, dimensions)
    error: float = 0.0  # standard deviation of 2 q.(x - x') over |q|

    @property
    def flat(self) -> np.ndarray:
        return self.books.reshape(-1, self.books.shape[2])

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Codes of the rows of x, the best of a beam of partial sums."""
        return np.concatenate([np.empty((0, len(self.books)), dtype=np.uint8), *[self._encode(x[a : a + 1024], beam) for a in range(0, len(x), 1024)]])

    def _encode(self, x: np.ndarray, beam: int) -> np.ndarray:
        n, (m, k, d) = len(x), self.books.shape
        rest, cost = x[:, None, :].astype(np.float32), np.zeros((n, 1), dtype=np.float32)
        codes = np.zeros((n, 1, 0), dtype=np.uint8)
        for book in self.books:
            h = rest.shape[1]
            gain = rest.reshape(-1, d) @ book.T
            total = (cost[:, :, None] - 2 * gain.reshape(n, h, k) + (book * book).sum(axis=1)).reshape(n, h * k)
            keep = min(beam, h * k)
            best = np.argpartition(total, keep - 1, axis=1)[:, :keep] if keep < h * k else np.tile(np.arange(h * k), (n, 1))
            cost = np.take_along_axis(total, best, axis=1)
            parent, code = best // k, best % k
            rest = np.take_along_axis(rest, parent[:, :, None], axis=1) - book[code]
            codes = np.concatenate((np.take_along_axis(codes, parent[:, :, None], axis=1), code[:, :, None].astype(np.uint8)), axis=2)
        return codes[np.arange(n), cost.argmin(axis=1)]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(book[codes[:, i]] for i, book in enumerate(self.books))


def fit(x: np.ndarray, books: int = BOOKS, codes: int = CODES, rounds: int = ROUNDS, seed: int = 11) -> Quantizer:
    """A quantizer of the rows of x (at least one)."""
    rng, x = np.random.default_rng(seed), x.astype(np.float32)
    x = x[rng.permutation(len(x))]
    held = x[: len(x) // HELD_OUT] if len(x) >= 20 * HELD_OUT else x  # codebooks fit their own rows better than others
    x = x[len(held) :] if len(held) < len(x) else x
    k = int(min(codes, max(1, len(x) // 4)))
    rest, made = x.copy(), []
    for _ in range(books):
        centres = rest[rng.choice(len(rest), k, replace=False)].copy()
        for _ in range(6):
            near = ((centres * centres).sum(axis=1) - 2 * rest @ centres.T).argmin(axis=1)
            count = np.bincount(near, minlength=k)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, rest)
            centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
        near = ((centres * centres).sum(axis=1) - 2 * rest @ centres.T).argmin(axis=1)
        rest -= centres[near]
        made.append(centres)
    q = Quantizer(np.stack(made).astype(np.float32))
    for _ in range(rounds):
        at = q.encode(x).astype(np.int64) + np.arange(books) * k
        gram = np.zeros((books * k, books * k))
        for i in range(books):
            for j in range(books):
                np.add.at(gram, (at[:, i], at[:, j]), 1.0)
        right = np.zeros((books * k, x.shape[1]))
        for i in range(books):
            np.add.at(right, at[:, i], x)
        solved = np.linalg.solve(gram + 1e-2 * np.eye(len(gram)), right + 1e-2 * q.flat)
        q = Quantizer(solved.reshape(q.books.shape).astype(np.float32))
    error = held - q.decode(q.encode(held))
    ask = held[rng.permutation(len(held))]
    q.error = float(np.std(2 * (ask * error).sum(axis=1) / np.maximum(np.linalg.norm(ask, axis=1), 1e-30)))
    return q


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, components summed in order."""
    total = np.zeros(len(x))
    for d in range(x.shape[1]):
        step = x[:, d].astype(np.float64) - np.float64(q[d])
        total += step * step
    return np.sqrt(total)


class Search:
    """The nearest rows of a pack of queries, fed with chunks of the index."""

    def __init__(self, ids: np.ndarray, nearest: int):
        self.ids, self.nearest = ids, nearest
        self.bound = np.full(len(ids), np.inf)
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0), np.empty(0, dtype=np.int64)) for _ in ids]

    def feed(self, quantizer: Quantizer, queries: np.ndarray, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, norms: np.ndarray, margin: float = MARGIN) -> None:
        tables = queries.astype(np.float32) @ quantizer.flat.T
        squares = (queries.astype(np.float64) ** 2).sum(axis=1)
        margins = margin * quantizer.error * np.sqrt(squares) + 1e-6 * (1 + squares)
        at = codes.astype(np.int64) + np.arange(len(quantizer.books)) * quantizer.books.shape[1]
        for i, own in enumerate(self.ids):
            score = norms - 2 * tables[i][at].sum(axis=1)  # the squared distance, less the query's square
            limit = self.bound[i] ** 2 - squares[i]
            if len(score) > self.nearest + 1:
                limit = min(limit, float(np.partition(score, self.nearest + 1)[self.nearest + 1]))
            near = np.flatnonzero((score <= limit + margins[i]) & (ids != own))
            if not len(near):
                continue
            d, who = np.concatenate((self.best[i][0], distances(queries[i], x[near]))), np.concatenate((self.best[i][1], ids[near]))
            order = np.lexsort((who, d))
            _, first = np.unique(who[order], return_index=True)  # a repeated id once
            order = order[np.sort(first)][: self.nearest]
            self.best[i] = d[order], who[order]
            if len(order) == self.nearest:
                self.bound[i] = d[order[-1]]

    def rows(self) -> dict[str, np.ndarray]:
        sizes = [len(d) for d, _ in self.best]
        return {"query_id": np.repeat(self.ids, sizes), "vec_id": np.concatenate([w for _, w in self.best]), "score": np.concatenate([d for d, _ in self.best])}


def usable(vector: Column) -> Column:
    """Not null, not zero, and of finite components only."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def build(df: DataFrame, key: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE) -> tuple[DataFrame, Quantizer] | None:
    """(index, quantizer): key, x, codes and norm of every usable row, written; None without any."""
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("x")).where(F.col("key").isNotNull() & usable(F.col(vector)))
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not common:
        return None
    rows = rows.where(F.size("x") == common[0]["d"])
    chosen = rows.orderBy(F.xxhash64("key"), "x").limit(sample).select("x").toArrow()
    quantizer = fit(_matrix(chosen.column("x").combine_chunks(), common[0]["d"]))
    schema = T.StructType([rows.schema["key"], rows.schema["x"], T.StructField("codes", T.BinaryType()), T.StructField("norm", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, ROWS):
                batch = whole.slice(a, ROWS)
                x = _matrix(batch.column("x"), common[0]["d"])
                codes = quantizer.encode(x)
                norms = (x.astype(np.float64) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_pydict({"key": batch.column("key"), "x": batch.column("x"), "codes": [c.tobytes() for c in codes], "norm": norms}, schema=pa.schema([("key", pa.int64()), ("x", batch.column("x").type), ("codes", pa.binary()), ("norm", pa.float64())]))

    return written(rows.mapInArrow(run, schema), "additive-index"), quantizer


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def _packed(df: DataFrame, rows: int) -> DataFrame:
    """pack, ids, x, codes, norms: runs of rows of an index as binary columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k = TaskContext.get().partitionId() << 32, 0
        for whole in batches:
            for a in range(0, whole.num_rows, rows):
                batch = whole.slice(a, rows)
                vectors = np.ascontiguousarray(batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64))
                yield pa.RecordBatch.from_pydict({
                    "pack": [task + k], "ids": [batch.column("key").to_numpy().astype(np.int64).tobytes()], "x": [vectors.tobytes()],
                    "codes": [b"".join(batch.column("codes").to_pylist())], "norms": [batch.column("norm").to_numpy().tobytes()],
                })
                k += 1

    return df.select("key", "x", "codes", "norm").mapInArrow(run, "pack long, ids binary, x binary, codes binary, norms binary")


def search(df: DataFrame, queries: Column, nearest: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the nearest rows of each row that queries picks (an expression on key)."""
    spark = df.sparkSession
    built = build(df, key, vector)
    if built is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index, quantizer = built
    d = quantizer.books.shape[2]
    found = []
    with Scratch(spark) as at:
        asked = index.withColumnRenamed("key", key).where(queries).groupBy(F.col(key).alias("key")).agg(F.min("x").alias("x"))
        n = asked.count()
        passes = -(-n * (8 * d + 16) // GROUP_BYTES)
        dealt = asked.withColumn("pass", F.pmod(F.xxhash64("key"), F.lit(max(1, passes))))
        no_codes = [F.lit(b"").alias("codes"), F.lit(0.0).alias("norm")]
        for p in range(passes):
            own = dealt.where(F.col("pass") == p).select("key", "x", *no_codes)
            blocks = at.write(_packed(own.repartition(-(-n // passes // PACK_QUERIES // 4) or 1), PACK_QUERIES), "queries")
            best = _pass(_packed(index, PACK_ROWS), blocks, quantizer, nearest)
            found.append(at.write(_ranked(best, nearest), "found"))
        rows = found[0] if found else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        for more in found[1:]:
            rows = rows.unionAll(more)
        return written(rows, "nearest")


def _ranked(found: DataFrame, nearest: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def _pass(index: DataFrame, blocks: DataFrame, quantizer: Quantizer, nearest: int) -> DataFrame:
    """query_id, vec_id, score: of each task and query of blocks, the nearest rows of the task's part of the index. Every block meets every index pack."""
    asked = blocks.select(F.col("pack").alias("block"), F.col("ids").alias("asked_ids"), F.col("x").alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, held = quantizer.books.shape[2], {}
        part = lambda column, kind, i: np.frombuffer(column[i].as_py(), dtype=kind)
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.column("block")[i].as_py()
                if block not in held:
                    held[block] = Search(part(batch.column("asked_ids"), np.int64, i), nearest)
                queries, x = (part(batch.column(c), np.float64, i).reshape(-1, d) for c in ("asked", "x"))
                codes = part(batch.column("codes"), np.uint8, i).reshape(len(x), -1)
                held[block].feed(quantizer, queries, part(batch.column("ids"), np.int64, i), x, codes, part(batch.column("norms"), np.float64, i))
        for task in held.values():
            yield pa.RecordBatch.from_pydict(task.rows())

    return index.crossJoin(F.broadcast(asked)).mapInArrow(run, "query_id long, vec_id long, score double")
