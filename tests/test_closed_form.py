"""Cases whose results are known."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.errors import ColumnError, FallbackWarning, FitError, InputError, LarkspurError, OverlapError, SplitError
from larkspur.functions import stats_dist as D
from larkspur.functions.tasks import infer_task
from larkspur.operators import audit as A
from larkspur.operators import guard as G
from larkspur.operators import inference as I
from larkspur.operators import metrics as M
from larkspur.operators import permute as P
from larkspur.operators import resample as R
from larkspur.operators import splits as S
from larkspur.operators import tune as T
from larkspur.operators import uncertainty as U
from larkspur.sources.folds import export_folds, import_folds
from larkspur.sources.report import audit_report, provenance


def frame(spark, n=20):
    rows = [(i, (i - 1) // 2 + 1, "abc"[i % 3], "ABCD"[i % 4], i, i % 2, math.sin(i), math.cos(3 * i)) for i in range(1, n + 1)]
    return spark.createDataFrame(rows, "row_id long, subject long, batch string, study string, time long, outcome int, x1 double, x2 double")


def truth_pred(spark, truth, pred):
    return spark.createDataFrame([(float(t), float(p)) for t, p in zip(truth, pred)], "truth double, pred double")


def test_distributions():
    assert abs(D.norm_ppf(0.975) - 1.959964) < 1e-6
    assert abs(D.t_ppf(0.975, 4) - 2.776445) < 1e-5
    assert abs(D.chi2_sf(7.814728, 3) - 0.05) < 1e-6
    assert abs(D.f_sf(4.0, 2, 10) - 0.05289) < 1e-4
    assert abs(D.t_sf2(2.0, 10) - 0.0733880) < 1e-6


def test_cindex(spark):
    value = lambda p, t: M.cindex(truth_pred(spark, t, p)).first()["cindex"]
    assert value((0.1, 0.2, 0.3), (1, 2, 3)) == 1.0
    assert value((0.3, 0.2, 0.1), (1, 2, 3)) == 0.0
    assert value((0.1,), (1,)) is None
    assert value((0.1, 0.2), (1, 1)) is None
    rng = np.random.default_rng(0)
    t, p = rng.integers(0, 40, 300), rng.integers(0, 20, 300)
    good = pairs = 0
    for i in range(300):
        for j in range(300):
            if t[i] > t[j]:
                pairs += 1
                good += 1.0 if p[i] > p[j] else 0.5 if p[i] == p[j] else 0.0
    assert abs(value(p, t) - good / pairs) < 1e-12


def test_small_metrics(spark):
    assert abs(M.rmse(truth_pred(spark, (1, 2, 3), (1, 2, 4))).first()["rmse"] - math.sqrt(1 / 3)) < 1e-12
    df = truth_pred(spark, (0, 1, 0, 1), (0.1, 0.9, 0.2, 0.8))
    assert M.auc(df).first()["auc"] == 1.0
    assert M.auc(truth_pred(spark, (1, 1), (0.1, 0.2))).first()["auc"] is None
    assert M.auc(truth_pred(spark, (1, 0), (0.1, 0.2)), direction="auto").first()["auc"] == 1.0
    assert M.pr_auc(df).first()["pr_auc"] == pytest.approx(1.0)
    with pytest.raises(InputError):
        M.evaluate(df, "rmse", "binomial")


def test_chisq(spark):
    rows = [(a, b) for (a, b), n in {(0, 0): 5, (1, 0): 2, (0, 1): 1, (1, 1): 3}.items() for _ in range(n)]
    r = A.chisq_assoc(spark.createDataFrame(rows, "a int, b int"), "a", "b").first()
    e = np.array([[6 * 7, 6 * 4], [5 * 7, 5 * 4]]) / 11
    o = np.array([[5, 1], [2, 3]])
    assert r["stat"] == pytest.approx(((np.abs(o - e) - np.minimum(0.5, np.abs(o - e))) ** 2 / e).sum())
    assert A.chisq_assoc(spark.createDataFrame([(0, 0), (0, 1)], "a int, b int"), "a", "b").first()["stat"] is None


def test_winsorize_and_impute(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([-100.0, 0.0, 1.0, 2.0, 100.0])], "id int, a double")
    model = G.fit(df, ["a"], config=G.GuardConfig(winsor_k=1.0, normalize="none"), id_col="id")
    values = [r["a"] for r in model.transform(df, ["id"]).collect()]
    assert min(values) >= 0.0 and max(values) <= 2.0
    holes = spark.createDataFrame([(1, 1.0, None), (2, None, 4.0), (3, 3.0, 5.0), (4, float("nan"), 6.0)], "id int, a double, b double")
    out = G.fit(holes, ["a", "b"], id_col="id").transform(holes, ["id"])
    assert out.where("a is null or b is null").count() == 0
    with pytest.warns(FallbackWarning):
        model = G.fit(holes, ["a", "b"], config=G.GuardConfig(impute="none"), id_col="id")
    assert {"a__missing", "b__missing"} <= set(model.columns)
    knn = G.fit(holes, ["a", "b"], config=G.GuardConfig(impute="knn", knn_k=1), id_col="id").transform(holes, ["id"])
    assert knn.where("a is null or b is null or isnan(a) or isnan(b)").count() == 0
    with pytest.raises(InputError):
        G.fit(holes, ["a"], config=G.GuardConfig(impute="mice"))
    assert model.transform(holes.drop("b"), ["id"]).where("b != 0 and b is not null").count() >= 0


def test_train_only_statistics(spark):
    df = frame(spark)
    model = G.fit(df.where("row_id <= 10"), ["x1", "x2"], config=G.GuardConfig(winsorize=False), id_col="row_id")
    again = G.fit(df.where("row_id <= 10"), ["x1", "x2"], config=G.GuardConfig(winsorize=False), id_col="row_id")
    assert model.stats == again.stats
    changed = df.withColumn("x1", F.when(F.col("row_id") > 10, 1e6).otherwise(F.col("x1")))
    assert G.fit(changed.where("row_id <= 10"), ["x1", "x2"], config=G.GuardConfig(winsorize=False), id_col="row_id").stats == model.stats


def test_impute_guarded_and_pipeline(spark):
    df = frame(spark).withColumn("x1", F.when(F.col("row_id") % 4 != 0, F.col("x1")))
    out = G.impute_guarded(df.where("row_id <= 12"), df.where("row_id > 12"), ["x1", "x2"], "row_id")
    assert out["test"].where("x1 is null").count() == 0
    assert {(r["part"], r["feature"]): r["n_missing"] for r in out["summary"].collect()}["train", "x1"] == 3
    with pytest.warns(FallbackWarning):
        assert len(G.to_pipeline(G.GuardConfig(normalize="robust", select="lasso"), ["x1", "x2"]).getStages()) == 3
    missing = G.fit(df, ["x1", "x2"], config=G.GuardConfig(impute="missforest", forest_rounds=1, forest_trees=3), id_col="row_id")
    assert missing.transform(df, ["row_id"]).where("x1 is null").count() == 0


@pytest.mark.parametrize("purge,embargo,last", [(0, 0, 4), (2, 0, 3), (0, 5, 3)])
def test_time_gaps(spark, purge, embargo, last):
    plan = S.make_split_plan(frame(spark, 12), "time_series", id_col="row_id", time="time", v=3, purge=purge, embargo=embargo)
    train = plan.train().where("fold = 2").join(plan.samples, "row_id")
    first = plan.blocks().where("fold = 2").first()
    expected = first["tmin"] - 1 if not purge else first["tmin"] - purge
    if embargo:
        expected = min(expected, first["tmax"] - embargo)
    assert train.agg(F.max("time")).first()[0] == expected
    assert expected <= last


def test_time_tail_and_no_folds(spark):
    plan = S.make_split_plan(frame(spark, 10), "time_series", id_col="row_id", time="time", v=3)
    assert plan.assign.orderBy(F.desc("row_id")).first()["fold"] == 3
    with pytest.raises(SplitError):
        S.make_split_plan(frame(spark, 4), "time_series", id_col="row_id", time="time", v=2, horizon=100).validate()


def test_grouped_plan_properties(spark):
    df = frame(spark, 60)
    plan = S.make_split_plan(df, "subject_grouped", id_col="row_id", group="subject", v=5, repeats=2, outcome="outcome", stratify=True)
    assert plan.assign.groupBy("row_id", "repeat_id").count().where("count != 1").count() == 0
    assert S.check_split_overlap(plan, stop_on_fail=True).where("not pass").count() == 0
    with pytest.raises(OverlapError):
        S.check_split_overlap(plan, ["batch" if "batch" in plan.samples.columns else "outcome"], stop_on_fail=True)
    a, b = (S.make_split_plan(df.repartition(k), "subject_grouped", id_col="row_id", group="subject", seed=3).plan_hash().first()["plan_hash"] for k in (1, 7))
    assert a == b
    with pytest.raises(ColumnError):
        S.make_split_plan(df.withColumn("subject", F.when(F.col("row_id") > 1, F.col("subject"))), "subject_grouped", id_col="row_id", group="subject")
    with pytest.raises(InputError):
        S.make_split_plan(df, "other", id_col="row_id")


def test_combined_plan_excludes_all_axes(spark):
    rows = [(s * 3 + k, s, "ABCDEFGHIJ"[s % 10], s % 10) for s in range(30) for k in range(3)]
    df = spark.createDataFrame(rows, "row_id long, subject long, batch string, site long")
    plan = S.make_split_plan(df, "combined", id_col="row_id", constraints=["subject", "batch", "site"], v=3)
    assert S.check_split_overlap(plan, ["subject", "batch", "site"]).where("n_overlap > 0").count() == 0
    assert plan.summary().count() == 3
    comps = S.constraint_components(df, ["subject", "batch"])
    assert comps.select("component").distinct().count() == 10


def test_nested_inner_folds_are_disjoint(spark):
    plan = S.make_split_plan(frame(spark, 48), "subject_grouped", id_col="row_id", group="subject", v=2, seed=6)
    inner = S.nested_plan(plan, 2)
    assert inner.groupBy("outer_fold", "row_id").count().where("count > 1").count() == 0
    outside = inner.join(plan.assign, "row_id").where("outer_fold = fold")
    assert outside.count() == 0


def test_fold_round_trip(spark):
    df = frame(spark).drop("batch", "study", "time")
    plan = S.make_split_plan(df, "subject_grouped", id_col="row_id", group="subject", v=4)
    out = export_folds(plan).where("role = 'test'").select("row_id", "id")
    back = import_folds(out, df, "row_id")
    both = back.assign.alias("a").join(plan.assign.alias("b"), "row_id")
    assert both.select("a.fold", "b.fold").distinct().count() == 4


def test_uncertainty(spark):
    rows = spark.createDataFrame([(i, "m", v) for i, v in enumerate([0.9, None, None, None, 0.7])], "fold int, learner string, auc double")
    r = U.cv_ci(rows, ["auc"])[0]
    assert r["mean"] == pytest.approx(0.8) and math.isfinite(r["ci_lo"])
    vals = spark.createDataFrame([(i, "m", v) for i, v in enumerate([0.7, 0.8, 0.9, 0.75, 0.85])], "fold int, learner string, auc double")
    s = U.cv_summary(vals, ["auc"]).first()
    assert s["se_nb"] ** 2 == pytest.approx(np.var([0.7, 0.8, 0.9, 0.75, 0.85], ddof=1) / 5)
    assert math.isnan(U.se_ci_delta(0.1, 0.05, [])["se"])
    assert U.se_ci_delta(0.1, 0.05, [0.5] * 10)["se"] == 0.05
    assert U.permutation_p([0.1, 0.2, 0.9], 0.5)["p_value"] == 0.5


def test_inference(spark):
    assert I.sign_flip([1.0, 1.0])["p_value"] == 0.5
    assert I.sign_flip([1.0] * 4, block_size=2) == {"p_value": 0.5, "n_blocks": 2}
    assert abs(I.huber([0, 0, 0, 0, 0, 100])) < 100 / 6
    two = spark.createDataFrame([(1, 1.0), (2, 1.0)], "repeat_id int, delta double")
    assert I.signflip_table(two).first()["p_value"] == 0.5
    assert [I.tier(n) for n in (20, 10, 5, 4)] == ["A", "B", "C", "D"]
    assert I.higher_is_better("auc") and not I.higher_is_better("log_loss")
    lo, hi = I.bca_interval(list(np.linspace(0.05, 0.15, 20)), draws=300)
    assert 0.05 < lo < 0.1 < hi < 0.15


def test_permutations_keep_the_labels(spark):
    df = spark.createDataFrame([(i + 1, s, i + 1, i) for i, s in enumerate(["s1", "s1", "s2", "s2", "s3", "s3"])], "row_id long, subject string, y int, time long")
    for labels in (P.shuffled(df, "row_id", "y", 3), P.subject_blocks(df, "row_id", "subject", "y", 3)):
        for b in (1, 2, 3):
            assert sorted(r["y"] for r in labels.where(F.col("b") == b).collect()) == [1, 2, 3, 4, 5, 6]
    assert P.circular_blocks(df, "row_id", "time", "y", 2, length=2).count() == 12
    assert P.stationary(df, "row_id", "time", "y", 2, mean_block=2).count() == 12


def test_near_duplicates(spark):
    base = [[math.sin(i * 3.1 + k), math.cos(i * 1.7 * (k + 1))] for i in range(1, 13) for k in (0,)]
    base[6], base[7] = base[0], base[1]
    df = spark.createDataFrame([(i + 1, v) for i, v in enumerate(base)], "row_id long, v array<double>")
    pairs = {(r["i"], r["j"]) for r in A.near_duplicates(df, "row_id", "v", 0.999).collect()}
    assert {(1, 7), (2, 8)} <= pairs
    assert A.near_duplicates(df.where("row_id > 100"), "row_id", "v").count() == 0
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2600, 8))
    x[1] = x[0] + 1e-6
    big = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "row_id long, v array<double>")
    assert (0, 1) in {(r["i"], r["j"]) for r in A.near_duplicates(big, "row_id", "v", 0.99).collect()}


def test_p_adjust_list():
    assert A.p_adjust_list([0.01, 0.04, 0.03, None], "BH") == [pytest.approx(0.03), pytest.approx(0.04), pytest.approx(0.04), None]
    assert A.p_adjust_list([0.01, 0.02, 0.5], "holm") == pytest.approx([0.03, 0.04, 0.5])
    assert A.p_adjust_list([0.01, 0.9], "bonferroni") == pytest.approx([0.02, 1.0])


def test_fit_audit_report(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, i // 2, i % 3, int(v > 0), float(v + rng.normal() * 0.5), float(rng.normal())) for i, v in enumerate(rng.normal(size=120))]
    df = spark.createDataFrame(rows, "row_id long, subject long, batch long, y int, x1 double, x2 double")
    plan = S.make_split_plan(df, "subject_grouped", id_col="row_id", group="subject", batch="batch", outcome="y", v=3)

    def broken(x, y, task, w):
        raise ValueError("no")

    fit = R.fit_resample(df, "y", plan, "binomial", {"a": "logistic", "bad": (broken, lambda m, x, t: x), "own": (lambda x, y, t, w: None, lambda m, x, t: x[:, 0])}, ["x1", "x2"])
    states = {(r["learner"], r["status"]) for r in fit.fold_status.collect()}
    assert ("bad", "failed") in states and ("a", "success") in states
    assert {r["learner"]: r["mean"] for r in fit.summary().where("metric = 'auc'").collect()}["a"] > 0.8
    audit = A.audit_leakage(fit.predictions, plan, "auc", "binomial", 10, features=["x1"], outcome="y", samples=df, learner="a")
    assert audit.permutation_gap["gap"] > 0.2 and audit.mechanisms[0]["mechanism_class"] == "non_random_signal"
    path = audit_report(audit, str(tmp_path / "a.html"), about=provenance(spark))
    assert "Leakage audit" in open(path).read()
    with pytest.raises(InputError):
        R.fit_resample(df, "y", plan, "binomial", {"logistic": (broken, broken)}, ["x1"])
    with pytest.raises(FitError):
        R.fit_resample(df, "y", plan, "binomial", {"bad": (broken, broken)}, ["x1"])
    ml = R.fit_resample(df, "y", plan, "binomial", {"net": "elastic_net"}, ["x1", "x2"])
    assert ml.metrics.count() == 3


def test_threshold_ties(spark):
    df = truth_pred(spark, (0, 1, 0, 1), (0.1, 0.4, 0.45, 0.6))
    best = T.threshold_select(df).first()
    assert best["value"] == pytest.approx(0.8) and 0.1 < best["threshold"] <= 0.4


def test_tasks_and_errors(spark):
    df = frame(spark)
    assert infer_task(df, "outcome") == "binomial" and infer_task(df, "x1") == "gaussian" and infer_task(df, "batch", factor=True) == "multiclass"
    assert infer_task(df, ("time", "outcome")) == "survival"
    with pytest.raises(InputError):
        infer_task(df, "batch")
    assert issubclass(SplitError, LarkspurError)


def test_stream(spark, tmp_path):
    from larkspur.streaming.apply import monitor, transform_stream

    df = frame(spark).withColumn("ts", F.timestamp_seconds(F.col("time") * 600)).withColumn("pred", F.abs("x1"))
    df.write.parquet(str(tmp_path / "in"))
    model = G.fit(df, ["x1", "x2"], id_col="row_id")
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = transform_stream(stream, model, ["row_id"]).writeStream.format("memory").queryName("guarded").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("guarded").count() == 20
    q = monitor(stream, "ts", "outcome", "pred").writeStream.format("memory").queryName("monitored").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("monitored").agg(F.sum("n")).first()[0] == 20


def test_tables(spark):
    from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler

    from larkspur.errors import ValidationWarning
    from larkspur.sources import tables as TB

    df = frame(spark)
    with pytest.raises(InputError):
        TB.aligned(df, df.where("row_id > 3").select("row_id", "x1"), "row_id")
    with pytest.raises(InputError):
        TB.class_weights(df, "batch", {"a": 1.0})
    assert "x1" in TB.features(df, "row_id", ["outcome"]).columns
    p = spark.createDataFrame([(0.2, 0.8)], ["`.pred_b`".strip("`"), ".pred_a"]).select(TB.probabilities(spark.createDataFrame([(0.2, 0.8)], [".pred_b", ".pred_a"]), ["a", "b"]).alias("p"))
    assert p.first()["p"] == [0.8, 0.2]
    x = VectorAssembler(inputCols=["x1"], outputCol="f").transform(df)
    model = StandardScaler(inputCol="f", outputCol="g").fit(x)
    with pytest.warns(ValidationWarning):
        TB.check_pipeline([model])
    with pytest.raises(InputError):
        TB.check_pipeline([SQLTransformer(statement="SELECT lead(y) over (order by t) FROM __THIS__")], strict=True)
