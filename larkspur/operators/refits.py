"""Linear models refitted in every fold under permutations of the outcome: a task for a few permutations, none of which is a copy of the rows.

The table is written once, in the order of ids; a task holds the permuted
outcomes and the predictions, and reads the predictors in batches for each
Newton step (up to HELD_BYTES it keeps them).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.columns import Stored
from larkspur.operators import permute as P

HELD_BYTES = 64 << 20


def stored_rows(df: DataFrame, id_col: str, y: str, columns: list[str], folds: DataFrame) -> DataFrame:
    """at, id, text, y, fold, columns: rows for stored(), to be sorted by at and id. folds: id, fold; rows without one take part in permutations only."""
    slim = df.select(F.col(id_col).alias("id"), P.place_order(df, id_col).alias("at"), F.col(id_col).cast("string").alias("text"), F.col(y).cast("double").alias("y"), *[F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(columns)])
    return slim.join(folds.select(F.col(id_col).alias("id"), F.col("fold").cast("int")), "id", "left").withColumn("fold", F.coalesce("fold", F.lit(-1)))


def fold_scales(spark: SparkSession, held: Stored, p: int) -> dict:
    """fold -> (medians, means, deviations) of its train rows, as _scale() of resample has them; a task holds one column."""
    import pandas as pd

    def scales(batches):
        for pdf in batches:
            for j in pdf["b"]:
                x, fold = held.column(f"x{j}"), held.column("fold", np.int32)
                x[~np.isfinite(x)] = np.nan
                for f in np.unique(fold[fold >= 0]):
                    train = x[(fold != f) & (fold >= 0)]
                    med = float(np.nan_to_num(np.nanmedian(train))) if np.isfinite(train).any() else 0.0
                    train[np.isnan(train)] = med
                    sd = float(train.std(ddof=1)) if len(train) > 1 else 1.0
                    yield pd.DataFrame({"j": [j], "f": [f], "med": [med], "mean": [float(train.mean()) if len(train) else 0.0], "sd": [sd if np.isfinite(sd) and sd > 0 else 1.0]})

    rows = P.numbered(spark, 0, p - 1).mapInPandas(scales, "j int, f int, med double, mean double, sd double").collect()
    by = {(r["f"], r["j"]): r for r in rows}
    return {f: tuple(np.array([by[f, j][k] for j in range(p)]) for k in ("med", "mean", "sd")) for f in {r["f"] for r in rows}}


def permuted_values(spark: SparkSession, held: Stored, p: int, n: int, seed: int, logistic: bool, scales: dict | None, value: Callable) -> list:
    """(b, value, n) for b from 0, the outcome itself, to n. value: of truth and prediction of the rows that have one."""
    import pandas as pd

    def run(batches):
        texts, y, fold = P.texts_of(held), held.column("y"), held.column("fold", np.int32)
        names, kept = [f"x{j}" for j in range(p)], []
        for pdf in batches:
            for b in pdf["b"]:
                t = y if b == 0 else y[texts.order(P.draw_prefix(seed, int(b)))]

                def parts():
                    if kept:
                        yield from kept
                        return
                    at = 0
                    for batch in held.batches(*names):
                        x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
                        if held.rows * p * 8 <= HELD_BYTES:
                            kept.append((at, x))
                        yield at, x
                        at += len(x)

                pred = _out_of_fold(parts, t, fold, p, logistic, scales)
                ok = np.isfinite(pred) & np.isfinite(t)
                yield pd.DataFrame({"b": [int(b)], "value": [value(t[ok], pred[ok]) if ok.any() else np.nan], "n": [int(ok.sum())]})

    return P.numbered(spark, 0, n).mapInPandas(run, "b int, value double, n long").collect()


def _out_of_fold(parts: Callable, y: np.ndarray, fold: np.ndarray, p: int, logistic: bool, scales: dict | None, rounds: int = 25) -> np.ndarray:
    """Predictions of fit_logistic() or fit_ols() for the folds' test rows; NaN where a fold's train rows have other than two classes."""
    from larkspur.operators.audit import predict_linear

    ridge, q = (1e-6 if logistic else 1e-9), p + 1

    def scaled(x, f):
        if scales is None:
            return x
        med, mean, sd = scales[f]
        return (np.where(np.isfinite(x), x, med) - mean) / sd

    weights = {}
    for f in (int(v) for v in np.unique(fold[fold >= 0])):
        seen = np.unique(y[(fold != f) & (fold >= 0)])
        if (len(seen) == 2 and np.isfinite(seen).all()) if logistic else len(seen) >= 2:
            weights[f] = np.zeros(q)
    todo = set(weights)
    for _ in range(rounds if logistic else 1):
        h, s = {f: ridge * np.eye(q) for f in todo}, {f: ridge * weights[f] for f in todo}
        for at, x in parts() if todo else ():
            t, own = y[at : at + len(x)], fold[at : at + len(x)]
            shared = np.column_stack((np.ones(len(x)), x)) if scales is None else None
            for f in todo:
                a = shared if shared is not None else np.column_stack((np.ones(len(x)), scaled(x, f)))
                train = (own != f) & (own >= 0)
                chance = 1 / (1 + np.exp(-np.clip(a @ weights[f], -30, 30))) if logistic else np.zeros(len(x))
                g = np.maximum(chance * (1 - chance), 1e-9) * train if logistic else train.astype(float)
                h[f] += (a * g[:, None]).T @ a
                s[f] += a.T @ np.where(train, chance - t, 0.0)
        for f in sorted(todo):
            step = np.linalg.solve(h[f], s[f])
            weights[f] -= step
            if np.abs(step).max() < 1e-9:
                todo.discard(f)
    out = np.full(len(y), np.nan)
    for at, x in parts():
        own = fold[at : at + len(x)]
        for f, w in weights.items():
            test = np.flatnonzero(own == f)
            out[at + test] = predict_linear(w, scaled(x[test], f), logistic)
    return out
