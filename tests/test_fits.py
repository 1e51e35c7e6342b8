"""Fits beyond those that SQL checks: learners of several kinds, tuning, reports."""

import tracemalloc
import warnings
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.errors import InputError
from larkspur.operators import audit, diagnostics, guard, resample, tune
from larkspur.operators import learners as nets
from larkspur.operators.splits import make_split_plan
from larkspur.sources.report import audit_report


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(240):
        a, b = rng.normal(size=2)
        rows.append((i, i // 4, float(a), float(b), int(a + rng.normal() * 0.5 > 0), str(int(a > -0.5) + int(a > 0.5)), float(np.exp(-a) * rng.exponential()), int(rng.random() < 0.8)))
    return spark.createDataFrame(rows, "id long, subject long, a double, b double, y int, k string, t double, e int")


@pytest.fixture(scope="module")
def plan(data):
    return make_split_plan(data, "subject_grouped", id_col="id", group="subject", v=3)


def test_elastic_nets_of_all_tasks(data, plan):
    for task, outcome, metric, least in (("binomial", "y", "auc", 0.85), ("multiclass", "k", "accuracy", 0.8), ("survival", "t", "cindex", 0.65)):
        fit = resample.fit_resample(data, outcome, plan, task, {"net": "elastic_net"}, ["a", "b"], event="e" if task == "survival" else None)
        assert fit.metrics.agg(F.avg(metric)).first()[0] > least, task
        assert fit.fold_status.where("status <> 'success'").count() == 0


def test_slopes_are_those_of_the_losses():
    rng = np.random.default_rng(0)
    w = rng.random(50) + 0.5
    for task in ("gaussian", "binomial", "multiclass", "survival"):
        y = nets._target({"gaussian": rng.normal(size=50), "binomial": rng.integers(0, 2, 50), "multiclass": rng.integers(0, 3, 50), "survival": np.column_stack((np.round(rng.exponential(size=50), 1), rng.integers(0, 2, 50)))}[task], task)
        s = rng.normal(size=(50, y.shape[1] if task == "multiclass" else 1))
        loss, slope = nets._loss(task, s, y, w)
        for i in range(0, 50, 7):
            moved = s.copy()
            moved[i, 0] += 1e-6
            assert (nets._loss(task, moved, y, w)[0] - loss) / 1e-6 == pytest.approx(slope[i, 0], abs=1e-5)


def test_forest_estimator_weights_and_final_model(data, plan):
    from pyspark.ml.classification import LogisticRegression

    fit = resample.fit_resample(data, "k", plan, "multiclass", {"trees": "forest", "lr": LogisticRegression(weightCol="weight", maxIter=20)}, ["a", "b"], ["accuracy", "log_loss"], {"0": 2.0, "1": 1.0, "2": 1.0}, refit=True)
    assert fit.metrics.groupBy("learner").agg(F.avg("accuracy").alias("v")).where("v > 0.8").count() == 2
    row = fit.predictions.first()
    assert row["pred_0"] + row["pred_1"] + row["pred_2"] == pytest.approx(1.0)
    assert fit.final["learner"] == "trees" and fit.final["model"].numClasses == 3
    assert "trees accuracy" in fit.describe()


def test_metrics_and_tasks_that_do_not_fit(data, plan):
    with pytest.warns(UserWarning):
        assert resample.resolve_metrics(["rmse"], "binomial")[0] == ["auc", "pr_auc", "accuracy", "log_loss"]
    with pytest.raises(InputError):
        resample.resolve_metrics([("own", None)], "survival")
    with pytest.raises(InputError):
        resample.fit_resample(data, "y", plan, "binomial", {"x": "ols"}, ["a"])
    with pytest.raises(InputError):
        resample.fit_resample(data, "t", plan, "survival", {"x": "elastic_net"}, ["a"])


def test_permutation_modes_report_and_plots(data, plan, tmp_path):
    fit = resample.fit_resample(data, "y", plan, "binomial", {"lr": "logistic"}, ["a", "b"])
    assert resample.permutation_gap(fit, n=5)["mode"] == "refit"
    fixed = resample.permutation_gap(fit, n=5, refit_most=3)
    assert fixed["mode"] == "fixed" and fixed["gap"] > 0.2
    assert diagnostics.plot(fit, "calibration").count() > 0
    where = audit_report(fit, str(tmp_path / "r.html"))
    with open(where) as f:
        assert "Permutation gap" in f.read()


def test_tuning_result(data, plan):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        r = tune.tune_resample(data, "y", ["a", "b"], plan, tune.grid(ridge=[0.01, 1.0]), {"ridge": "desc"}, metric="roc_auc", tune_threshold=True)
    assert {x["status"] for x in r.fold_status.collect()} == {"success"} and r.fold_status.count() == 3
    s = r.summary()[0]
    assert s["metric"] == "auc" and s["mean"] > 0.8 and s["ci_lo"] < s["mean"] < s["ci_hi"]
    assert r.stability().first()["n"] == 3
    a = audit.audit_tuned(r, plan, n=5)
    assert a.info["learner"] == "tuned" and a.permutation_gap["gap"] > 0.2 and len(a.info["hash"]) == 64
    assert tune.usable_metrics(["auc", "accuracy"], data.select(F.lit(1).alias("outer_repeat"), F.lit(1).alias("outer_fold"), F.col("y").alias("fold"), F.col("y").alias("truth"))) == ["accuracy"]


def test_guard_steps(data):
    model = guard.fit(data, ["a", "b"], ["k"], guard.GuardConfig())
    assert [s["step"] for s in model.steps()] == ["encode", "winsorize", "impute", "normalize", "filter", "select"]
    assert model.fingerprint() == guard.fit(data, ["a", "b"], ["k"], guard.GuardConfig()).fingerprint() and "encode" in model.describe()


def test_lasso_of_several_classes(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 4))
    df = spark.createDataFrame([(i, *map(float, r), int(r[0] > 0.4) + 2 * int(r[1] > 0.6)) for i, r in enumerate(x)], "id long, a double, b double, c double, d double, y int").withColumn("d", F.lit(1.0))
    model = guard.fit(df, ["a", "b", "c", "d"], config=guard.GuardConfig(select="lasso", task="multiclass"), y="y", id_col="id")
    assert set(model.columns[:2]) == {"a", "b"} and "d" not in model.columns


def test_folds_come_in_batches(monkeypatch):
    """A fold's task gets its rows batch by batch and holds arrays; linear fits go through slices of them."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    x, y, train = rng.normal(size=(900, 2)), rng.integers(2, size=900).astype(float), np.arange(900) % 3 > 0
    x[::11, 0] = np.nan
    a, b = resample._scale(x[train], x[~train])
    want = audit.predict_linear(audit.fit_logistic(a, y[train]), b, True)
    monkeypatch.setattr(audit, "FIT_ROWS", 100)
    monkeypatch.setattr(resample, "OUT_ROWS", 70)
    mixed = rng.permutation(900)
    table = pa.table({"train": train[mixed], "id": mixed, "y": y[mixed], "x": pa.array(list(x[mixed]), pa.list_(pa.float64()))})
    sizes = {(1, 2, "train"): int(train.sum()), (1, 2, "test"): int((~train).sum())}
    task = resample._fold_task({"logistic": "logistic"}, "binomial", "id", 2, 1, True, sizes)
    got = list(task((pa.scalar(1), pa.scalar(2)), iter(table.to_batches(max_chunksize=64))))
    assert len(got) == 5 and {r.num_rows for r in got} == {70, 20}
    rows = pa.Table.from_batches(got).to_pandas()
    assert rows["id"].tolist() == np.flatnonzero(~train).tolist() and np.allclose(rows["pred"], want) and set(rows["status"]) == {"success"}


def test_folds_read_one_table(spark, monkeypatch):
    """Folds whose train rows are all others read a table written once; the results are those of rows spelt out by fold."""
    rng = np.random.default_rng(11)
    rows = [(i, int(rng.integers(40)), int(rng.integers(2)) if i % 50 else None, float(rng.normal()) if i % 13 else None, float(i % 7)) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, g long, y int, a double, b double")
    plan = make_split_plan(df, "subject_grouped", id_col="id", group="g", v=4, repeats=2, check=False)
    weighed = (lambda x, y, task, w: float(np.average(y, weights=w)), lambda m, x, task: np.full(len(x), m))

    def fitted():
        fit = resample.fit_resample(df, "y", plan, "binomial", {"logistic": "logistic", "weighed": weighed}, ["a", "b"], ["accuracy"], {0: 1.0, 1: 3.0})
        return {(r["learner"], r["repeat_id"], r["fold"], r["id"]): (r["truth"], r["pred"]) for r in fit.predictions.collect()}, fit.info

    with monkeypatch.context() as m:
        m.setattr(type(plan), "fold_index", lambda self: pytest.fail("rows were spelt out by fold"))
        once, info = fitted()
    plan.info["exclude"] = ["none"]
    monkeypatch.setattr(type(plan), "train", lambda self, train=type(plan).train: train(replace(self, info=self.info | {"exclude": []})))
    spelt, same = fitted()
    assert len(once) == 2 * 2 * 600 and once.keys() == spelt.keys() and (info["n_train"], info["n_test"]) == (same["n_train"], same["n_test"])
    for key, (truth, pred) in once.items():
        assert truth == spelt[key][0] and abs(pred - spelt[key][1]) < 1e-9


def test_status_of_folds_that_read_one_table(spark, monkeypatch):
    df = spark.createDataFrame([(i, i % 10, float(i), float(i % 3)) for i in range(101)], "id long, g long, y double, a double")
    plan = make_split_plan(df, "subject_grouped", id_col="id", group="g", v=3, check=False)
    monkeypatch.setattr(type(plan), "fold_index", lambda self: pytest.fail("rows were spelt out by fold"))

    def fails(x, y, task, w):
        x[:], w[:] = 0, 0  # what a learner is given is its own
        if len(y) % 2 == 0:
            raise ValueError("an even number of rows")

    mean = (lambda x, y, task, w: float(np.average(y, weights=w)), lambda m, x, task: np.full(len(x), m))
    fit = resample.fit_resample(df, "y", plan, "gaussian", {"odd": (fails, lambda m, x, t: np.zeros(len(x))), "mean": mean}, ["a"], ["rmse"])
    sizes = {r["fold"]: 101 - r["count"] for r in plan.assign.groupBy("fold").count().collect()}
    got = {(r["learner"], r["fold"]): r["status"] for r in fit.fold_status.collect()}
    assert got == {(n, f): "failed" if n == "odd" and m % 2 == 0 else "success" for f, m in sizes.items() for n in ("odd", "mean")}


def test_status_is_hashed(spark):
    """A row for each fold and learner comes from a hash of few keys; no sort goes over the predictions."""
    df = spark.createDataFrame([(i, i % 10, float(i), float(i % 3)) for i in range(100)], "id long, g long, y double, a double")
    plan = make_split_plan(df, "subject_grouped", id_col="id", group="g", v=3, check=False)
    fit = resample.fit_resample(df, "y", plan, "gaussian", {"ols": "ols"}, ["a"], ["rmse"])
    assert "Sort" not in fit.fold_status._jdf.queryExecution().executedPlan().toString() and fit.fold_status.count() == 3


def test_learners_of_ones_own_get_no_copies():
    """What a learner wrote to is read anew for the next one, so a task never holds a fold twice; a failure is one row."""
    import pyarrow as pa

    n, of_10 = 1_000_000, np.arange(1_000_000) % 10
    table = pa.table({"repeat_id": np.ones(n, np.int32), "fold": (of_10 > 0).astype(np.int32), "id": np.arange(n), "y": of_10.astype(float), "x0": np.arange(n, dtype=float)})

    class Held:
        def batches(self, *columns):
            return iter(table.select(columns).to_batches(max_chunksize=10_000))

    def spoils(x, y, task, w):
        x[:], y[:], w[:] = 0, 0, 0

    def fails(x, y, task, w):
        spoils(x, y, task, w)
        raise ValueError("no fit")

    def zeros(m, x, task):
        x[:] = 0
        return x[:, 0]

    learners = {"spoils": (spoils, zeros), "fails": (fails, zeros), "mean": (lambda x, y, task, w: y.mean() * w.mean(), lambda m, x, task: np.full(len(x), m)), "raw": (lambda x, y, task, w: None, lambda m, x, task: x[:, 0])}
    sizes = {(1, 0, "train"): n - n // 10, (1, 0, "test"): n // 10}
    run = resample._stored_folds(resample._fold_task(learners, "gaussian", "id", 2, 1, True, sizes), Held(), [], 1, sizes)
    fold = pa.record_batch({"repeat_id": [1], "fold": [0]})
    tracemalloc.start()
    told = sum(batch.num_rows for batch in run([fold]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    got = pa.Table.from_batches(list(run([fold]))).to_pandas()
    assert told == len(got) and got.groupby("learner").size().to_dict() == {"spoils": n // 10, "fails": 1, "mean": n // 10, "raw": n // 10}
    assert got.loc[got["learner"] == "fails", ["status", "reason"]].values.tolist() == [["failed", "fold_error: no fit"]]
    train, test = (table["x0"].to_numpy()[m] for m in (of_10 > 0, of_10 == 0))
    pred = {name: part["pred"].to_numpy() for name, part in got.groupby("learner")}
    assert not pred["spoils"].any() and np.allclose(pred["mean"], 5) and np.allclose(pred["raw"], (test - train.mean()) / train.std(ddof=1))
    assert peak < 38 * n  # x and y of train rows and what scaling or weights take beside them; copies for a learner made it 49
