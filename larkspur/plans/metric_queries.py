"""Metrics and their uncertainty over the prediction frame of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import metrics as M
from larkspur.operators import uncertainty as U
from larkspur.plans.common import PRED, events, predictions, rounded


def metric_auc(spark, sf):
    return rounded(M.auc(events(spark, sf), "y", "score"), "auc")


def metric_auc_by_fold(spark, sf):
    return rounded(M.auc(predictions(spark, sf), "y", "score", ["fold"]), "auc")


def metric_auc_auto(spark, sf):
    return rounded(M.auc(events(spark, sf), "y", "score", ["event_type"], direction="auto"), "auc")


def metric_pr_auc(spark, sf):
    return rounded(M.pr_auc(events(spark, sf), "y", "score", ["event_type"]), "pr_auc")


def metric_accuracy(spark, sf):
    return rounded(M.accuracy(predictions(spark, sf), "y", "score", ["fold"]), "accuracy")


def metric_balanced_accuracy(spark, sf):
    return rounded(M.threshold_metrics(events(spark, sf), [0.25, 0.5, 0.75], "y", "score"), "accuracy", "balanced_accuracy", "f1")


def metric_macro_f1(spark, sf):
    e = events(spark, sf).withColumns({"t": F.col("event_id") % 4, "g": F.floor(F.col("score") * 5).cast("long")})
    return rounded(M.macro_f1(e, "t", "g", ["event_type"]), "macro_f1")


def metric_log_loss(spark, sf):
    return rounded(M.log_loss(predictions(spark, sf), "y", "score", ["fold"]), "log_loss")


def metric_multiclass_log_loss(spark, sf):
    s = F.col("score")
    e = events(spark, sf).withColumns({"t": F.concat(F.lit("c"), F.col("event_id") % 3), "p": F.array(s / 2 + 0.1, (1 - s) / 2 + 0.1, F.lit(0.3))})
    return rounded(M.multiclass_log_loss(e, ["c0", "c1", "c2"], "t", "p", ["event_type"]), "log_loss")


def metric_rmse(spark, sf):
    return rounded(M.rmse(predictions(spark, sf).withColumn("p", F.col("score") * 100), "x", "p", ["fold"]), "rmse")


def metric_cindex(spark, sf):
    return rounded(M.cindex(events(spark, sf), "x", "score", ["user_id"]), "cindex")


def metric_cindex_pooled(spark, sf):
    return rounded(M.cindex(events(spark, sf), "x", "score"), "cindex")


def metric_cindex_survival(spark, sf):
    return rounded(M.cindex(events(spark, sf), "x", "score", ["user_id"], event="y", risk=True), "cindex")


def metric_brier(spark, sf):
    return rounded(M.brier(predictions(spark, sf), "y", "score", ["fold"]), "brier")


def cvauc_if_variance(spark, sf):
    return M.cvauc_if(predictions(spark, sf), "y", "score", ["fold"]).select("fold", F.round("auc", 6).alias("auc"), F.round("var_if", 9).alias("var_if"), "n1", "n0")


def cvauc_pooled(spark, sf):
    return M.pooled_cvauc(M.cvauc_if(predictions(spark, sf), "y", "score", ["fold"])).select(F.round("mean_auc", 6).alias("mean_auc"), F.round("var_auc", 9).alias("var_auc"), "n_folds")


def cv_summary_nb(spark, sf):
    p = predictions(spark, sf)
    folds = M.auc(p, "y", "score", ["fold"]).join(M.accuracy(p, "y", "score", ["fold"]), "fold").withColumn("learner", F.lit("score"))
    return rounded(U.cv_summary(folds, ["auc", "accuracy"], n_train=4, n_test=1), "mean", "sd", "se", "se_nb")


QUERIES = {f.__name__: f for f in (
    metric_auc, metric_auc_by_fold, metric_auc_auto, metric_pr_auc, metric_accuracy, metric_balanced_accuracy, metric_macro_f1, metric_log_loss, metric_multiclass_log_loss, metric_rmse, metric_cindex, metric_cindex_pooled,
    metric_cindex_survival, metric_brier, cvauc_if_variance, cvauc_pooled, cv_summary_nb,
)}


def _auc(by: str, source: str) -> str:
    keys, part = (f"{by}, ", f"partition by {by} ") if by else ("", "")
    return f"""mid as (select {keys}y, rank() over ({part}order by score) + (count(*) over (partition by {keys}score) - 1) / 2.0 as r from {source}),
auc as (select {keys}(sum(r) filter (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) as auc from mid {f"group by {by}" if by else ""})"""


_CINDEX = "sum(case when a.score > b.score then 1.0 when a.score = b.score then 0.5 else 0 end) / nullif(count(*), 0)"
_V = """t as (select fold, sum(y) as t1, count(*) - sum(y) as t0 from pred group by fold),
m as (select pred.fold, y, rank() over w + (count(*) over (partition by pred.fold, score) - 1) / 2.0 as r_all,
  rank() over (partition by pred.fold, y order by score) + (count(*) over (partition by pred.fold, y, score) - 1) / 2.0 as r_own from pred window w as (partition by pred.fold order by score)),
v as (select m.fold, y, case when y = 1 then (r_all - r_own) / t0 else 1 - (r_all - r_own) / t1 end as v from m join t on t.fold = m.fold),
f as (select fold, avg(v) filter (y = 1) as auc, var_samp(v) filter (y = 1) / sum(y) + var_samp(v) filter (y = 0) / (count(*) - sum(y)) as var_if, cast(sum(y) as bigint) as n1, cast(count(*) - sum(y) as bigint) as n0 from v group by fold)"""

ORACLES = {
    "metric_auc": f"with {PRED}, {_auc('', 'pred')} select round(auc, 6) as auc from auc",
    "metric_auc_by_fold": f"with {PRED}, {_auc('fold', 'pred')} select fold, round(auc, 6) as auc from auc",
    "metric_auc_auto": f"""with {PRED}, {_auc('event_type', 'pred')}, md as (select event_type, median(score) filter (y = 1) as m1, median(score) filter (y = 0) as m0 from pred group by event_type)
select auc.event_type, round(case when m0 > m1 then 1 - auc else auc end, 6) as auc from auc join md on md.event_type = auc.event_type""",
    "metric_pr_auc": f"""with {PRED}, s as (select event_type, score, sum(y)::double as d1, (count(*) - sum(y))::double as d0 from pred group by event_type, score),
c as (select *, sum(d1) over w - d1 as t0, sum(d0) over w - d0 as f0 from s window w as (partition by event_type order by score desc rows unbounded preceding)),
a as (select event_type, d1, case when d1 > 0 then case when t0 + f0 > 0 then d1 / (1 + d0 / d1) + (t0 - (t0 + f0) / (1 + d0 / d1)) / (1 + d0 / d1) * ln((t0 + f0 + d1 + d0) / (t0 + f0)) else d1 / (1 + d0 / d1) end end as area from c)
select event_type, round(sum(area) / sum(d1), 6) as pr_auc from a group by event_type""",
    "metric_accuracy": f"with {PRED} select fold, round(avg(case when (score >= 0.5)::int = y then 1.0 else 0.0 end), 6) as accuracy from pred group by fold",
    "metric_balanced_accuracy": f"""with {PRED}, c as (select t as threshold, count(*) filter (y = 1 and score >= t)::double as tp, count(*) filter (y = 1 and score < t)::double as fn, count(*) filter (y = 0 and score >= t)::double as fp, count(*) filter (y = 0 and score < t)::double as tn
  from pred, (select unnest([0.25::double, 0.5::double, 0.75::double]) as t) group by t)
select threshold, round((tp + tn) / (tp + fn + fp + tn), 6) as accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) as balanced_accuracy, round(2 * tp / (2 * tp + fp + fn), 6) as f1 from c""",
    "metric_macro_f1": f"""with {PRED}, e as (select event_type, event_id % 4 as t, cast(floor(score * 5) as bigint) as g from pred),
k as (select distinct event_type, t as c from e),
f as (select k.event_type, k.c, 2.0 * count(*) filter (e.t = c and e.g = c) / (count(*) filter (e.t = c) + count(*) filter (e.g = c)) as f1 from k join e on e.event_type = k.event_type group by k.event_type, k.c)
select event_type, round(avg(f1), 6) as macro_f1 from f group by event_type""",
    "metric_log_loss": f"with {PRED} select fold, round(-avg(case when y = 1 then ln(least(greatest(score, 1e-15), 1 - 1e-15)) else ln(1 - least(greatest(score, 1e-15), 1 - 1e-15)) end), 6) as log_loss from pred group by fold",
    "metric_multiclass_log_loss": f"with {PRED} select event_type, round(-avg(ln(case event_id % 3 when 0 then score / 2 + 0.1 when 1 then (1 - score) / 2 + 0.1 else 0.3 end)), 6) as log_loss from pred group by event_type",
    "metric_rmse": f"with {PRED} select fold, round(sqrt(avg(pow(x - score * 100, 2))), 6) as rmse from pred group by fold",
    "metric_cindex": f"with {PRED} select a.user_id, round({_CINDEX}, 6) as cindex from pred a join pred b on a.user_id = b.user_id and a.x > b.x group by a.user_id",
    "metric_cindex_pooled": f"with {PRED} select round({_CINDEX}, 6) as cindex from pred a join pred b on a.x > b.x",
    "metric_cindex_survival": f"""with {PRED}, c as (select a.user_id, sum(case when a.score < b.score then 1.0 when a.score = b.score then 0.5 else 0 end) / count(*) as c from pred a join pred b on a.user_id = b.user_id and a.x > b.x and b.y = 1 group by a.user_id)
select u.user_id, round(c.c, 6) as cindex from (select distinct user_id from pred) u left join c on c.user_id = u.user_id""",
    "metric_brier": f"with {PRED} select fold, round(avg(pow(y - score, 2)), 6) as brier from pred group by fold",
    "cvauc_if_variance": f"with {PRED}, {_V} select fold, round(auc, 6) as auc, round(var_if, 9) as var_if, n1, n0 from f",
    "cvauc_pooled": f"with {PRED}, {_V} select round(avg(auc), 6) as mean_auc, round(sum(var_if) / (count(*) * count(*)), 9) as var_auc, count(*) as n_folds from f",
    "cv_summary_nb": f"""with {PRED}, {_auc('fold', 'pred')}, ac as (select fold, avg(case when (score >= 0.5)::int = y then 1.0 else 0.0 end) as v from pred group by fold),
l as (select 'auc' as metric, auc as v from auc union all select 'accuracy', v from ac)
select 'score' as learner, metric, count(v) as k, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as sd, round(stddev_samp(v) / sqrt(count(v)), 6) as se, round(sqrt(var_samp(v) * (1.0 / count(v) + 0.25)), 6) as se_nb from l group by metric""",
}
