"""A text quality classifier: naive Bayes support vectors.

Features are presence indicators of character n-grams of one to three, of word
unigrams and bigrams, and of word bigrams and trigrams of one word over and
over (any word) that occur once, three times, seven times and so on, hashed
into 2**18 places. Each indicator is scaled
by the log-count ratio of the two classes; a linear model on the scaled
indicators is fit to the hinge loss by dual coordinate descent. Margins become
probabilities by a logistic fit on folds that the margins were not trained on.

The model is fit on the driver from at most SAMPLE labelled rows (those with
the smallest hashes of their text), whose hashed features are all that leaves
the executors; every row is scored, each from its whole text. Features don't
use the label, the id, the language or the source.

Defined results: a null text is an empty one and is scored too; labels other
than 0 and 1, and those of texts that aren't there, are left out; of repeated
labels of one id the largest counts; with labels of one class only, or none,
each score is the smoothed share of label 1; each row gives one row. A null id
is not held out and is never trained on. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.frames import map_batches, struct
from larkspur.llm.shingles import Spans, mix, text_slices, words_of
from larkspur.llm.storage import sized

BITS = 18
SAMPLE = 4_000  # labelled rows the model is fit on at most
EPOCHS = 12
COST = 1.0
NORM = 0.25  # a row is divided by its number of features to this power
FOLDS = 3
_CHAR_BITS = 16  # character n-grams take the first 2**16 places, repeats the last 2**12, words the others


def _presence(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(texts, text of each feature, feature): distinct features of slices of texts, by text."""
    small, rest = np.uint64((1 << _CHAR_BITS) - 1), np.uint64((1 << BITS) - (1 << _CHAR_BITS) - (1 << 12))
    for _, _, data, offsets in text_slices(column, 1 << 17):
        n = len(offsets) - 1
        sizes = np.diff(offsets)
        text = np.repeat(np.arange(n, dtype=np.int64), sizes)
        seen = np.zeros((n, 1 << _CHAR_BITS), dtype=bool) if n * (1 << _CHAR_BITS) <= 1 << 24 else None
        keys = []
        code, left = np.zeros(len(data), dtype=np.uint64), np.repeat(offsets[1:], sizes) - np.arange(len(data))
        for k in (1, 2, 3):
            code[: len(data) - k + 1] = (code[: len(data) - k + 1] << np.uint64(8)) | data[k - 1 :]
            within = left >= k
            f = (mix(code[within] + np.uint64(k << 32)) & small).astype(np.int64)
            if seen is not None:
                seen[text[within], f] = True
            else:
                keys.append(np.unique(text[within] << BITS | f))
        if seen is not None:
            at = np.flatnonzero(seen.reshape(-1))
            keys.append((at >> _CHAR_BITS) << BITS | (at & ((1 << _CHAR_BITS) - 1)))
        starts, ends, first = words_of(data, offsets)
        h = Spans(data, lower=False)(starts, ends)
        owner = np.repeat(np.arange(n, dtype=np.int64), np.diff(first))
        for part, of in ((h, owner), (mix(h[:-1] * np.uint64(3) + h[1:])[owner[:-1] == owner[1:]], owner[:-1][owner[:-1] == owner[1:]])):
            keys.append(of << BITS | ((1 << _CHAR_BITS) + (part % rest).astype(np.int64)))
        keys.append(_repeats(h, owner, n))
        key = np.unique(np.concatenate(keys))
        yield n, key >> BITS, key & ((1 << BITS) - 1)


def _repeats(h: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Indicators of bigrams and trigrams of one word over and over: that they occur 2**k - 1 times or more, for each k."""
    again = np.zeros(len(h), dtype=bool)
    again[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    twice = again.copy()
    twice[1:] &= again[:-1]
    keys = []
    for kind, flags in ((1, again), (2, twice)):
        steps = np.floor(np.log2(np.bincount(owner[flags], minlength=n) + 1.0)).astype(np.int64)
        text = np.repeat(np.arange(n, dtype=np.int64), steps)
        k = np.arange(len(text)) - np.repeat(np.cumsum(steps) - steps, steps) + 1
        keys.append(text << BITS | ((1 << BITS) - 1 - (mix((kind << 12 | k).astype(np.uint64)) % np.uint64(1 << 12)).astype(np.int64)))
    return np.concatenate(keys)


@dataclass
class Model:
    weights: np.ndarray  # of each feature, log-count ratio included
    bias: float
    slope: float
    shift: float

    def margins(self, column: pa.Array) -> np.ndarray:
        out = []
        for n, text, feature in _presence(column):
            size = np.bincount(text, minlength=n)
            out.append(np.bincount(text, self.weights[feature], minlength=n) / np.maximum(size, 1) ** NORM + self.bias)
        return np.concatenate([*out, np.empty(0)])

    def scores(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(column) + self.shift, -30, 30)))


def _ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Log-count ratios with add-one smoothing."""
    counts = np.ones((2, 1 << BITS))
    for r, c in zip(rows, y.tolist()):
        counts[0 if c == 1 else 1][r] += 1.0  # a row's features are distinct
    return np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())


def _descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float, epochs: int, seed: int = 7) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss; rows count by class so that both weigh the same."""
    scaled = lambda r: ratio[r] / max(1, len(r)) ** NORM  # noqa: E731  made anew each time: a sample's values would fill the driver's memory
    square = np.array([np.square(scaled(r)).sum() + 1.0 for r in rows])
    share = np.array([(y == 1).mean(), (y == -1).mean()])
    upper = cost * 0.5 / np.where(y == 1, share[0], share[1])
    w, b, alpha = np.zeros(1 << BITS), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)).tolist():
            values = scaled(rows[i])
            gradient = y[i] * (w[rows[i]] @ values + b) - 1.0
            new = min(max(alpha[i] - gradient / square[i], 0.0), upper[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[rows[i]] += step * values
                b += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3 * cost:
            break
    return w * ratio, b


def _logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of P(1 | margin), with the usual smoothed targets; the slope is kept positive."""
    pos, neg = (y == 1).sum(), (y == -1).sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, c = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + c, -30, 30)))
        d, s = p - t, np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(s * m * m).sum() + 1e-6, (s * m).sum()], [(s * m).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, [(d * m).sum() + 1e-6 * (a - 1), d.sum()])
        step *= min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
        a, c = max(1e-3, a - step[0]), c - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(c)


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, cost: float = COST, epochs: int = EPOCHS) -> Model:
    """A model of feature rows and labels 0 or 1. With a single class, or no row, every score is the smoothed share of label 1."""
    y = np.where(np.asarray(labels) == 1, 1, -1)
    share = ((y == 1).sum() + 1) / (len(y) + 2)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(1 << BITS, dtype=np.float32), 0.0, 1.0, float(np.log(share / (1 - share))))
    margins, known = np.zeros(len(y)), np.zeros(len(y), dtype=bool)
    for k in range(FOLDS):
        train, test = [i for i in range(len(y)) if i % FOLDS != k], [i for i in range(len(y)) if i % FOLDS == k]
        if len(set(y[train].tolist())) < 2 or not test:
            continue
        own = [rows[i] for i in train]
        w, b = _descend(own, y[train], _ratios(own, y[train]), cost, epochs)
        for i in test:
            margins[i], known[i] = w[rows[i]].sum() / max(1, len(rows[i])) ** NORM + b, True
    slope, shift = _logistic(margins[known], y[known]) if known.any() else (1.0, 0.0)
    w, b = _descend(rows, y, _ratios(rows, y), cost, epochs)
    return Model(w.astype(np.float32), float(b), slope, shift)


def features(column: pa.Array) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for n, text, feature in _presence(column):
        cut = np.searchsorted(text, np.arange(n + 1))
        out += [feature[a:b] for a, b in zip(cut[:-1], cut[1:])]
    return out


def held_out(key: str) -> F.Column:
    """crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """A model of at most sample labelled rows that aren't held out."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~held_out(key)).groupBy(key).agg(F.max(label).alias("y"))
    order = F.xxhash64(F.col(key).cast("string"))
    chosen = known.orderBy(order, key).limit(sample)
    joined = docs.select(key, text).join(F.broadcast(chosen), key)

    def run(batch: pa.RecordBatch) -> dict:
        rows = features(batch.column("text"))
        ends = np.cumsum([0] + [len(r) for r in rows])
        flat = np.concatenate([*rows, np.empty(0, dtype=np.int64)]).astype(np.int32)
        return {"k": batch.column("k"), "y": batch.column("y"), "f": pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(flat))}

    rows = joined.select(order.alias("k"), F.col("y").cast("int").alias("y"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("y", T.IntegerType()), T.StructField("f", T.ArrayType(T.IntegerType()))])
    found = map_batches(rows, run, schema).orderBy("k").limit(sample).toArrow().combine_chunks()
    lists = found.column("f").combine_chunks()
    ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    model = fit_rows([flat[a:b] for a, b in zip(ends[:-1], ends[1:])], found.column("y").to_numpy())
    del found, lists, flat
    pa.default_memory_pool().release_unused()
    return model


def score(df: DataFrame, model: Model, text: str = "text", keep: list[str] = ("doc_id",)) -> DataFrame:
    """keep, score: each row's probability of label 1."""

    def run(batch: pa.RecordBatch) -> dict:
        return {c: batch.column(c) for c in keep} | {"score": model.scores(batch.column(text))}

    return map_batches(df.select(*dict.fromkeys([*keep, text])), run, struct(df, list(keep), score=T.DoubleType()))


def keep_good(df: DataFrame, model: Model, threshold: float, text: str = "text") -> DataFrame:
    """The rows of df whose score is at least threshold, with all their columns."""
    names = df.columns

    def run(batch: pa.RecordBatch) -> dict:
        kept = batch.filter(pa.array(model.scores(batch.column(text)) >= threshold))
        return {c: kept.column(c) for c in names}

    return sized(map_batches(df, run, df.schema), df)
