"""The ways taken for large tables give the same rows as those for small ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur import ids
from larkspur.operators import audit, guard, metrics


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(2)), float(rng.choice([1e9, *np.round(rng.normal(size=3), 1)]))) for i in range(700)]
    return spark.createDataFrame(rows + [(1000, 1, None)], "id long, y int, score double")


def test_running_sums_by_quantile_buckets(frame, monkeypatch):
    ties = frame.where("score is not null").groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    small = sorted(map(tuple, ids.running(ties, [], "score", {"c": "n"}).select("score", "c").collect()))
    monkeypatch.setattr(ids, "SORT_ROWS", 0)
    assert sorted(map(tuple, ids.running(ties, [], "score", {"c": "n"}).select("score", "c").collect())) == small
    assert small[-1][1] == 700


def test_bracketed_quantiles(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=5000), 2)
    df = spark.createDataFrame([(float(v), None if i % 7 else float(i)) for i, v in enumerate(x)], "a double, b double").withColumn("none", F.lit(None).cast("double"))
    exact = guard.column_stats(df, ["a", "b", "none"])
    monkeypatch.setattr(guard, "EXACT_ROWS", 0)
    monkeypatch.setattr(guard, "SKETCH", 400)
    assert guard.column_stats(df, ["a", "b", "none"]) == exact
    assert exact["a"]["median"] == pytest.approx(float(np.median(x))) and exact["none"]["mad"] is None


def test_shuffled_auc_by_rank_sums(frame):
    from larkspur.operators import permute

    fast = dict(map(tuple, audit.permutation_values(frame, "id", "auc", "binomial", 4, "y", "score").collect()))
    labels = permute.shuffled(frame, "id", "y", 4)
    slow = dict(map(tuple, metrics.auc(labels.join(frame.select("id", "score"), "id"), "y", "score", ["b"]).collect()))
    assert fast == pytest.approx(slow)


def test_second_moments(spark):
    x = np.random.default_rng(2).normal(size=(300, 4))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x] + [(None, 1.0, 1.0, None)], "a double, b double, c double, d double").repartition(5)
    y = np.vstack((x, [0, 1, 1, 0]))
    assert np.allclose(guard.second_moments(df, ["a", "b", "c", "d"]), y.T @ y)


def test_hash_order_by_numpy():
    import hashlib

    import pyarrow as pa

    from larkspur.functions.hashing import Texts

    texts = [str(i) for i in range(0, 3000, 7)] + ["", "x" * 60, "é|3", "12|4"]
    held = Texts()
    held.add(pa.array(texts[:100]))
    held.add(pa.array(texts)[100:])
    want = sorted(range(len(texts)), key=lambda i: (hashlib.md5(b"17|perm|" + texts[i].encode()).hexdigest(), i))
    assert held.order(b"17|perm|").tolist() == want
    codes = (np.arange(len(texts)) % 3).astype(np.int8)
    assert held.drawn(b"17|perm|", codes).tolist() == codes[want].tolist()


@pytest.mark.parametrize("key", ["id", "name"])
def test_permuted_auc_needs_no_copies_of_rows(frame, monkeypatch, key):
    from larkspur.operators import permute

    named = frame.withColumn("name", F.concat_ws("|", "id", F.lit(1)))
    monkeypatch.setattr(audit, "TASK_ROWS", 0)
    shuffled = dict(map(tuple, audit.permutation_values(named, key, "auc", "binomial", 4, "y", "score").collect()))
    monkeypatch.undo()
    monkeypatch.setattr(permute, "draws", None)  # a row for each row and permutation
    assert dict(map(tuple, audit.permutation_values(named, key, "auc", "binomial", 4, "y", "score").collect())) == pytest.approx(shuffled)


def test_refits_need_no_copies_of_rows(spark, monkeypatch):
    from larkspur.operators import permute, resample
    from larkspur.operators.splits import make_split_plan

    rng = np.random.default_rng(8)
    rows = [(i, i % 30, float(a) if i % 9 else None, float(b), int(a + b + rng.normal() > 0)) for i, (a, b) in enumerate(rng.normal(size=(400, 2)))]
    df = spark.createDataFrame(rows, "id long, g long, a double, b double, y int")
    plan = make_split_plan(df, "subject_grouped", id_col="id", group="g", v=3, check=False)
    both = lambda: (resample.refit_gap(df, "y", plan, ["a", "b"], 3), audit.multivariate_scan(df, ["a", "b"], "y", "id", plan, "binomial", 3))
    monkeypatch.setattr(audit, "TASK_ROWS", 0)
    monkeypatch.setattr(resample, "TASK_ROWS", 0)
    gap, scan = both()
    monkeypatch.undo()
    monkeypatch.setattr(permute, "draws", None)  # a row for each row and permutation
    for got, want in zip(both(), (gap, scan)):
        assert {k: v for k, v in got.items() if k != "metric"} == pytest.approx({k: v for k, v in want.items() if k != "metric"})


def test_knn_compares_rows_in_reach_only(spark, monkeypatch):
    from larkspur.functions import neighbours as N

    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(4000, 2)), 2)
    cells = N.Cells(x[::5], 80, 2)
    own, compared = cells.of(x), 0
    for cell in np.unique(own):
        ask, code = np.flatnonzero(own == cell), np.arange(len(x))
        at, found, d = N.k_nearest(x[ask], code[ask], x[ask], code[ask], 3)
        who, more = cells.others(cell, x[ask], d.reshape(-1, 3)[:, 2])
        compared += len(ask) + len(who)
    assert len(np.unique(own)) == 80 and compared < 3 * len(x)  # of 80 cells, each row meets under three
    monkeypatch.setattr(guard, "REFERENCE_ROWS", 16)
    rows = [(f"r{i}", None if i % 4 == 0 else float(i * i % 7), float(i % 5) if i < 90 else 2.0) for i in range(300)] + [("r1", 1.0, float("inf")), (None, 2.0, 2.0)]
    df = spark.createDataFrame(rows, "id string, x double, z double")
    stats = {"x": {"median": 3.0, "sd": 2.0}, "z": {"median": 2.0, "sd": 0.5}}
    got = {r["id"]: r["x"] for r in guard.knn_fill(df, ["id"], df, ["x", "z"], stats, 4).collect()}
    full = [(i, 3.0 if x is None else x, z) for i, x, z in rows]
    for i, x, z in rows[:300:4]:
        near = sorted((round(((a - 3.0) / 2.0) ** 2 + ((b - z) / 0.5) ** 2, 9), j is None, j or "", a) for j, a, b in full if j != i and b < float("inf"))[:4]
        assert got[i] == sum(r[3] for r in near) / 4


def test_near_duplicates_send_few_copies(spark, monkeypatch):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i, [float(v) for v in rng.normal(size=4)]) for i in range(1500)], "id long, v array<double>")

    def found(rows, size):
        sent = []
        monkeypatch.setattr(audit, "BLOCK_ROWS", rows)
        monkeypatch.setattr(audit, "BLOCK_BYTES", size)
        monkeypatch.setattr("larkspur.operators.splits.checkpointed", lambda pairs: sent.append(pairs.count()) or pairs)
        return {(r["i"], r["j"]): round(r["sim"], 9) for r in audit.near_duplicates(df, "id", "v", 0.7).collect()}, sent[0]

    small, many = found(64, 0)
    large, few = found(64, 1500 * 4 * 8)
    assert large == small and len(small) > 1500 and few * 2 < many
