"""Fits over folds whose results have a closed form, so that SQL can check them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from larkspur.operators import diagnostics as D
from larkspur.operators import guard as G
from larkspur.operators import inference as I
from larkspur.operators import resample as R
from larkspur.operators import tune as T
from larkspur.operators.audit import tuned_predictions
from larkspur.operators.splits import make_split_plan
from larkspur.plans.common import EV, PRED, events, predictions, rounded, subject_plan, table
from larkspur.sources.folds import import_folds
from larkspur.sources.tables import aligned

MEAN = (lambda x, y, task, w: float(np.average(y, weights=w)), lambda m, x, task: np.full(len(x), m))
SHARES = (lambda x, y, task, w: np.bincount(y.astype(int), w) / w.sum(), lambda m, x, task: np.tile(m, (len(x), 1)))
RISK = (lambda x, y, task, w: None, lambda m, x, task: x[:, 0])


def _mae(df, truth, pred, by):
    return df.groupBy(*by).agg(F.avg(F.abs(F.col(truth) - F.col(pred))).alias("mae"))


def _plan_of(df):
    return make_split_plan(df, "subject_grouped", id_col="event_id", group="user_id", check=False)


def fit_ols_predictions(spark, sf):
    """Least squares of x on one predictor, its holes filled by the train median, scaled by train deviations."""
    fit = R.fit_resample(events(spark, sf), "x", subject_plan(spark, sf), "gaussian", {"ols": "ols"}, ["score"])
    return rounded(fit.predictions.select("event_id", "fold", "fold_seq", "learner", "truth", "pred"), "truth", "pred")


def fit_guarded_ols(spark, sf):
    """The same after a guard that clips the predictor at the train median and one MAD."""
    config = G.GuardConfig(winsor_k=1.0)
    fit = R.fit_resample(events(spark, sf), "x", subject_plan(spark, sf), "gaussian", {"ols": "ols"}, ["score"], ["rmse"], preprocess=config)
    return rounded(fit.metrics.select("fold", "learner", "n_test", "rmse"), "rmse")


def fit_custom_learner(spark, sf):
    """A learner of one's own (the weighted mean of the train outcomes), class weights, and a metric of one's own."""
    fit = R.fit_resample(events(spark, sf), "y", subject_plan(spark, sf), "binomial", {"mean": MEAN}, ["score"], ["log_loss", ("mae", _mae)], {0: 1.0, 1: 3.0})
    return rounded(fit.metrics.select("fold", "learner", "n_test", "log_loss", "mae"), "log_loss", "mae")


def fit_multiclass(spark, sf):
    """Class shares of the train rows as probabilities."""
    fit = R.fit_resample(events(spark, sf), "event_type", _plan_of(events(spark, sf)), "multiclass", {"shares": SHARES}, ["score"])
    return rounded(fit.metrics.select("fold", "learner", "n_test", "accuracy", "macro_f1", "log_loss"), "accuracy", "macro_f1", "log_loss")


def fit_survival(spark, sf):
    """Concordance of a risk (the raw predictor, which scaling leaves in order) with times that are partly censored."""
    e = events(spark, sf).withColumn("seen", (F.col("event_id") % 3 > 0).cast("int")).where("event_id % 4 = 0")
    fit = R.fit_resample(e, "x", _plan_of(e), "survival", {"risk": RISK}, ["score"], event="seen")
    return rounded(fit.metrics.select("fold", "n_test", "cindex"), "cindex")


def fit_status(spark, sf):
    """A learner that fails in one fold, beside one that never does."""

    def fails(x, y, task, w):
        if len(y) % 2 == 0:
            raise ValueError("an even number of rows")

    fit = R.fit_resample(events(spark, sf), "x", subject_plan(spark, sf), "gaussian", {"even": (fails, lambda m, x, t: np.zeros(len(x))), "mean": MEAN}, ["score"], ["rmse"])
    return fit.fold_status.select("fold", "learner", "status", "reason")


def fit_summary(spark, sf):
    """Mean, deviation and corrected interval over folds."""
    fit = R.fit_resample(events(spark, sf), "x", subject_plan(spark, sf), "gaussian", {"mean": MEAN}, ["score"], ["rmse"])
    return rounded(fit.summary().select("learner", "metric", "mean", "sd", ((F.col("ci_hi") - F.col("ci_lo")) / 2).alias("half")), "mean", "sd", "half")


def fit_final(spark, sf):
    """The first learner on all rows."""
    fit = R.fit_resample(events(spark, sf), "y", subject_plan(spark, sf), "binomial", {"mean": MEAN}, ["score"], ["accuracy"], refit=True)
    return rounded(spark.createDataFrame([(fit.final["learner"], fit.final["model"])], "learner string, mean double"), "mean")


def fit_estimator(spark, sf):
    """A pyspark.ml Pipeline as learner, its stages fitted on each fold's train rows."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    model = Pipeline(stages=[VectorAssembler(inputCols=["score"], outputCol="features"), LinearRegression(solver="normal")])
    fit = R.fit_resample(events(spark, sf), "x", subject_plan(spark, sf), "gaussian", {"lm": model}, ["score"], ["rmse"])
    return rounded(fit.metrics.select("fold", "learner", "n_test", "rmse"), "rmse")


def tune_threshold_stability(spark, sf):
    """Spread of the thresholds that folds choose."""
    chosen = T.threshold_select(predictions(spark, sf), "y", "score", "f1", [0.1, 0.25, 0.5, 0.75], ["fold"])
    return rounded(T.threshold_stability(chosen), "mean", "sd")


def tune_outer_status(spark, sf):
    p = predictions(spark, sf).select(F.col("repeat_id").alias("outer_repeat"), F.col("fold").alias("outer_fold")).distinct()
    return T.outer_status(p, p.where("outer_fold <> 2"), p.where("outer_fold <> 3"))


def tuned_fold_sequence(spark, sf):
    """A tuning result's outer predictions as one learner's: rows and mean score by the outer fold's place."""
    plan = subject_plan(spark, sf, repeats=2)
    outer = events(spark, sf).join(plan.assign, "event_id").select(F.col("repeat_id").alias("outer_repeat"), F.col("fold").alias("outer_fold"), "event_id", F.col("y").alias("truth"), F.col("score").alias("pred"))
    return rounded(tuned_predictions(outer).groupBy("learner", "fold").agg(F.count(F.lit(1)).alias("n"), F.avg("pred").alias("mean")), "mean")


def fit_fold_metrics(spark, sf):
    """AUC of each fold, recomputed from a fit's predictions."""
    raw = (lambda x, y, task, w: None, lambda m, x, task: x[:, 0])
    fit = R.fit_resample(events(spark, sf), "y", subject_plan(spark, sf), "binomial", {"raw": raw}, ["score"], ["accuracy"])
    return rounded(I.fold_metrics(fit.predictions, "auc", learner="raw"), "value")


def calibration_plot(spark, sf):
    return rounded(D.calibration_plot(events(spark, sf).where("event_id % 50 = 0"), "y", "score", 10, 20), "mean_pred", "obs_rate", "lo", "hi")


def aligned_nonstrict(spark, sf):
    """Orders with their customers' segments; only half of the customers are known."""
    known = table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return aligned(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), known, "o_custkey", strict=False)


def folds_import_levels(spark, sf):
    """Foreign folds whose labels have an order of their own, and a role given by name."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("id"))
    order = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]
    plan = import_folds(o.select("o_orderkey", "id"), o.drop("id"), "o_orderkey", levels={"id": order}, split_cols={"group": "o_custkey"})
    return plan.assign.groupBy("repeat_id", "fold").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("least"))


QUERIES = {f.__name__: f for f in (
    fit_ols_predictions, fit_guarded_ols, fit_custom_learner, fit_multiclass, fit_survival, fit_status, fit_summary, fit_final, fit_estimator, tune_threshold_stability, tune_outer_status, tuned_fold_sequence, fit_fold_metrics, calibration_plot, aligned_nonstrict,
    folds_import_levels,
)}

_PAIRS = f"{PRED}, folds as (select unnest([1, 2, 3, 4, 5]) as f)"
_OLS = "line as (select f, regr_slope(x, score) as b, regr_intercept(x, score) as a from pred, folds where fold <> f group by f)"
_T4 = 2.7764451051977987  # Student's t at 0.975 with 4 degrees of freedom

ORACLES = {
    "fit_fold_metrics": f"""with {PRED}, r as (select fold, y, rank() over (partition by fold order by score) + (count(*) over (partition by fold, score) - 1) / 2.0 as r from pred)
select 1 as repeat_id, fold, round((sum(r) filter (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) as value, count(*) as n from r group by fold""",
    "calibration_plot": f"with {EV} select cast(greatest(1, ceil(score * 10)) as integer) as bin, count(*) as n, round(avg(score), 6) as mean_pred, round(avg(y), 6) as obs_rate, round(min(score), 6) as lo, round(max(score), 6) as hi from ev where event_id % 50 = 0 group by 1 having count(*) >= 20",
    "aligned_nonstrict": "select o_custkey, o_orderkey, c_mktsegment from orders left join (select * from customer where c_custkey % 2 = 0) on c_custkey = o_custkey",
    "folds_import_levels": """select 1 as repeat_id, cast(6 - cast(left(o_orderpriority, 1) as integer) as integer) as fold, count(*) as n, min(o_orderkey) as least from orders group by o_orderpriority""",
    "fit_ols_predictions": f"with {_PAIRS}, {_OLS} select event_id, fold, fold as fold_seq, 'ols' as learner, round(x, 6) as truth, round(a + b * score, 6) as pred from pred join line on fold = f",
    "fit_guarded_ols": f"""with {_PAIRS}, md as (select f, median(score) as m from pred, folds where fold <> f group by f),
mad as (select md.f, m, median(abs(score - m)) as d from pred, md where fold <> md.f group by md.f, m),
cut as (select f, event_id, fold, x, least(greatest(score, m - d), m + d) as s from pred, mad),
line as (select f, regr_slope(x, s) as b, regr_intercept(x, s) as a from cut where fold <> f group by f)
select fold, 'ols' as learner, count(*) as n_test, round(sqrt(avg(pow(x - (a + b * s), 2))), 6) as rmse from cut join line using (f) where fold = f group by fold""",
    "fit_custom_learner": f"""with {_PAIRS}, m as (select f, sum(y * (1 + 2 * y)) / sum(1 + 2 * y) as p from pred, folds where fold <> f group by f)
select fold, 'mean' as learner, count(*) as n_test, round(-avg(case when y = 1 then ln(p) else ln(1 - p) end), 6) as log_loss, round(avg(abs(y - p)), 6) as mae from pred join m on fold = f group by fold""",
    "fit_multiclass": f"""with {_PAIRS}, c as (select f, event_type as level, count(*)::double / sum(count(*)) over (partition by f) as p from pred, folds where fold <> f group by f, event_type),
best as (select f, level as guess from c qualify row_number() over (partition by f order by p desc, level) = 1),
t as (select fold, event_type, p, guess from pred join c on fold = c.f and event_type = level join best on fold = best.f),
f1 as (select fold, event_type, case when event_type = max(guess) then 2.0 * count(*) / (count(*) + max(n)) else 0 end as v from t join (select fold, count(*) as n from t group by fold) using (fold) group by fold, event_type)
select fold, 'shares' as learner, count(*) as n_test, round(avg((event_type = guess)::int), 6) as accuracy, round((select avg(v) from f1 where f1.fold = t.fold), 6) as macro_f1, round(-avg(ln(p)), 6) as log_loss from t group by fold""",
    "fit_survival": f"""with {EV}, e as (select * from ev where event_id % 4 = 0), g as (select user_id, cast((row_number() over (order by md5('1|split|1|' || user_id), user_id) - 1) % 5 + 1 as integer) as fold from (select distinct user_id from e)),
p as (select fold, x, score, (event_id % 3 > 0)::int as seen from e join g using (user_id)),
pairs as (select a.fold, case when a.score > b.score then 1.0 when a.score = b.score then 0.5 else 0.0 end as v from p a join p b on a.fold = b.fold and a.x < b.x and a.seen = 1)
select fold, (select count(*) from p where p.fold = pairs.fold) as n_test, round(avg(v), 6) as cindex from pairs group by fold""",
    "fit_status": f"""with {_PAIRS}, n as (select f, count(*) as n from pred, folds where fold <> f group by f)
select cast(f as integer) as fold, 'even' as learner, case when n % 2 = 0 then 'failed' else 'success' end as status, case when n % 2 = 0 then 'fold_error: an even number of rows' else '' end as reason from n
union all select cast(f as integer), 'mean', 'success', '' from n""",
    "fit_summary": f"""with {_PAIRS}, m as (select f, avg(x) as p from pred, folds where fold <> f group by f), r as (select fold, sqrt(avg(pow(x - p, 2))) as v from pred join m on fold = f group by fold)
select 'mean' as learner, 'rmse' as metric, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as sd, round({_T4} * sqrt(var_samp(v) * (1.0 / count(*) + 0.25)), 6) as half from r""",
    "fit_final": f"with {EV} select 'mean' as learner, round(avg(y), 6) as mean from ev",
    "fit_estimator": f"with {_PAIRS}, {_OLS} select fold, 'lm' as learner, count(*) as n_test, round(sqrt(avg(pow(x - (a + b * score), 2))), 6) as rmse from pred join line on fold = f group by fold",
    "tune_threshold_stability": f"""with {PRED}, c as (select fold, t as threshold, count(*) filter (y = 1 and score >= t)::double as tp, count(*) filter (y = 1 and score < t)::double as fn, count(*) filter (y = 0 and score >= t)::double as fp from pred, (select unnest([0.1::double, 0.25::double, 0.5::double, 0.75::double]) as t) group by fold, t),
b as (select fold, threshold from c qualify row_number() over (partition by fold order by 2 * tp / (2 * tp + fp + fn) desc, round(abs(threshold - 0.5), 9), threshold) = 1)
select count(*) as n, round(avg(threshold), 6) as mean, round(stddev_samp(threshold), 6) as sd, min(threshold) as lo, max(threshold) as hi from b""",
    "tune_outer_status": """select 1 as outer_repeat, cast(f as integer) as outer_fold, case f when 2 then 'failed' when 3 then 'skipped' else 'success' end as status, case f when 2 then 'no_valid_metrics' when 3 then 'single_class_training' else '' end as reason from (select unnest([1, 2, 3, 4, 5]) as f)""",
    "tuned_fold_sequence": f"""with {EV}, g as (select user_id, r, cast((row_number() over (partition by r order by md5('1|split|' || r || '|' || user_id), user_id) - 1) % 5 + 1 as integer) as fold from (select distinct user_id from ev), (select unnest([1, 2]) as r))
select 'tuned' as learner, cast((r - 1) * 5 + fold as integer) as fold, count(*) as n, round(avg(score), 6) as mean from ev join g using (user_id) group by r, fold""",
}
