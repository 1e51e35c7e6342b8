"""Diagnostics, inference, tuning, fits, simulation."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import diagnostics as G
from larkspur.operators import inference as I
from larkspur.operators import metrics as M
from larkspur.operators import resample as R
from larkspur.operators import simulate as SIM
from larkspur.operators import tune as T
from larkspur.plans.common import EV, PRED, events, predictions, rounded, subject_plan
from larkspur.streaming.apply import monitor


def calibration_curve(spark, sf):
    return rounded(G.calibration_curve(events(spark, sf), "y", "score"), "mean_pred", "obs_rate", "lo", "hi")


def calibration_ece_mce(spark, sf):
    return rounded(G.calibration_summary(events(spark, sf), "y", "score"), "ece", "mce", "brier")


def confounder_sensitivity(spark, sf):
    return rounded(G.confounder_sensitivity(events(spark, sf), ["event_type", "x"], "auc", "binomial", "y", "score"), "positive_rate", "value")


def fold_balance(spark, sf):
    return rounded(G.fold_balance(predictions(spark, sf), "y"), "share")


def perm_histogram(spark, sf):
    return rounded(G.histogram(events(spark, sf), "x", 12), "lo", "hi")


def pred_acf(spark, sf):
    return rounded(G.autocorrelation(events(spark, sf), "ts", "score", "event_id", 10), "acf", "bound")


def _repeats(spark, sf):
    """Fold scores of two pipelines over five repeats."""
    plan = subject_plan(spark, sf, repeats=5)
    p = events(spark, sf).join(plan.assign, "event_id")
    sized = p.groupBy("repeat_id", "fold").agg(F.count(F.lit(1)).alias("n"))
    a = M.auc(p, "y", "score", ["repeat_id", "fold"]).withColumnRenamed("auc", "value").join(sized, ["repeat_id", "fold"])
    b = M.accuracy(p, "y", "score", ["repeat_id", "fold"]).withColumnRenamed("accuracy", "value").join(sized, ["repeat_id", "fold"])
    return plan, a, b


def repeat_weighted_mean(spark, sf):
    return rounded(I.repeat_means(_repeats(spark, sf)[1]), "mean")


def delta_paired(spark, sf):
    _, a, b = _repeats(spark, sf)
    return rounded(I.deltas(a, b), "leaky", "guarded", "delta")


def signflip_exact(spark, sf):
    _, a, b = _repeats(spark, sf)
    return rounded(I.signflip_table(I.deltas(a, b)), "p_value")


def signflip_blocked_exact(spark, sf):
    _, a, b = _repeats(spark, sf)
    return rounded(I.signflip_table(I.deltas(a, b), block_size=2), "p_value")


def block_size_ar1(spark, sf):
    _, a, b = _repeats(spark, sf)
    return rounded(I.ar1_block_size(I.deltas(a, b)), "rho")


def pairing_check(spark, sf):
    return I.pairing(subject_plan(spark, sf, repeats=2).assign, subject_plan(spark, sf, repeats=2, v=4).assign, "event_id")


def delta_huber(spark, sf):
    _, a, b = _repeats(spark, sf)
    return spark.createDataFrame([(round(I.huber([r["delta"] for r in I.deltas(a, b).collect()]), 6),)], "huber double")


def delta_bca_ci(spark, sf):
    _, a, b = _repeats(spark, sf)
    lo, hi = I.bca_interval([r["delta"] for r in I.deltas(a, b).orderBy("repeat_id").collect()], draws=200)
    return spark.createDataFrame([(lo, hi)], "lo double, hi double")


def delta_full(spark, sf):
    plan, a, b = _repeats(spark, sf)
    r = I.delta_lsi(a, b, "auc", plans=(plan.assign, plan.assign, "event_id"))
    return rounded(spark.createDataFrame([(r.robust, r.p_value, r.tier, r.paired)], "robust double, p_value double, tier string, paired boolean"), "robust", "p_value")


def threshold_select(spark, sf):
    return rounded(T.threshold_select(predictions(spark, sf), "y", "score", "f1", [0.1, 0.25, 0.5, 0.75], ["fold"]), "value")


def _configs(spark, sf):
    scores = M.accuracy(predictions(spark, sf).withColumn("config", F.concat(F.lit("c"), F.col("event_id") % 4)), "y", "score", ["fold", "config"]).withColumnRenamed("accuracy", "value")
    params = spark.createDataFrame([("c0", 1.0, 3), ("c1", 2.0, 2), ("c2", 3.0, 1), ("c3", 4.0, 4)], "config string, penalty double, depth int")
    return scores, params


def config_table(spark, sf):
    return rounded(T.config_table(_configs(spark, sf)[0]), "mean", "sd", "se")


def config_select_one_se(spark, sf):
    scores, params = _configs(spark, sf)
    return rounded(T.select_config(scores, params, {"penalty": "desc", "depth": "asc"}, "one_std_err"), "mean")


def param_aggregate(spark, sf):
    e = events(spark, sf).select("x", "score", "event_type")
    return rounded(T.aggregate_params(e, ["x", "score"], ["event_type"]), "x", "score")


def fit_logistic_cv(spark, sf):
    e = events(spark, sf).withColumns({"u": F.col("user_id").cast("double"), "h": F.hour("ts").cast("double")})
    return R.fit_resample(e, "y", subject_plan(spark, sf), "binomial", {"logistic": "logistic"}, ["score", "u", "h"]).metrics


def perm_gap_refit(spark, sf):
    e = events(spark, sf).withColumn("h", F.hour("ts").cast("double"))
    g = R.refit_gap(e, "y", subject_plan(spark, sf), ["score", "h"], 20)
    return spark.createDataFrame([(g["metric_obs"], g["perm_mean"], g["gap"], g["p_value"])], "metric_obs double, perm_mean double, gap double, p_value double")


def tune_nested(spark, sf):
    e = events(spark, sf).withColumn("h", F.hour("ts").cast("double"))
    return T.tune_resample(e, "y", ["score", "h"], subject_plan(spark, sf), T.grid(ridge=[0.01, 1.0]), {"ridge": "desc"}).best


def simulate_suite(spark, sf):
    return SIM.simulate_suite(spark, [1, 2, 3], n=120, p=5, leakage="peek_norm")


def benchmark_grid(spark, sf):
    return SIM.benchmark_suite(spark, {"small": (80, 4)}, ["none", "peek_norm"], ["subject_grouped"], [1])


def stream_monitor(spark, sf):
    e = events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    out = monitor(e, "ts", "y", "score", "1 day")
    return rounded(out.select(F.unix_micros("start").alias("start_us"), "bin", "n", "mean_pred", "obs_rate"), "mean_pred", "obs_rate")


QUERIES = {f.__name__: f for f in (
    calibration_curve, calibration_ece_mce, confounder_sensitivity, fold_balance, perm_histogram, pred_acf, repeat_weighted_mean, delta_paired, signflip_exact, signflip_blocked_exact, block_size_ar1, pairing_check, delta_huber,
    delta_bca_ci, delta_full, threshold_select, config_table, config_select_one_se, param_aggregate, fit_logistic_cv, perm_gap_refit, tune_nested, simulate_suite, benchmark_grid, stream_monitor,
)}

_REP5 = """grp as (select user_id, r as repeat_id, cast((row_number() over (partition by r order by md5('1|split|' || r || '|' || user_id), user_id) - 1) % 5 + 1 as integer) as fold from (select distinct user_id from ev), (select unnest([1, 2, 3, 4, 5]) as r)),
p as (select ev.*, repeat_id, fold from ev join grp using (user_id)),
a as (select repeat_id, fold, (sum(r) filter (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) as value, count(*) as n from (select repeat_id, fold, y, rank() over (partition by repeat_id, fold order by score) + (count(*) over (partition by repeat_id, fold, score) - 1) / 2.0 as r from p) group by repeat_id, fold),
b as (select repeat_id, fold, avg(case when (score >= 0.5)::int = y then 1.0 else 0.0 end) as value, count(*) as n from p group by repeat_id, fold),
d as (select x.repeat_id, x.m as leaky, z.m as guarded, x.m - z.m as delta from (select repeat_id, sum(n * value) / sum(n) as m from a group by repeat_id) x join (select repeat_id, sum(n * value) / sum(n) as m from b group by repeat_id) z on z.repeat_id = x.repeat_id)"""


def _flip(size: int, alone: bool = True) -> str:
    return f"""{"" if alone else "with "}bl as (select k, sum(delta) as s, count(*) as m from (select delta, (row_number() over (order by repeat_id) - 1) // {size} as k from d) group by k),
t as (select sum(s) as total, count(*) as n_blocks, sum(m) as r from bl),
j as (select unnest(range(0, cast(pow(2, n_blocks) as bigint))) as j from t),
f as (select j.j, sum(bl.s * (1 - 2 * ((j.j >> bl.k::bigint) & 1))) as v from j, bl group by j.j)
select n_blocks, round(avg(case when abs(v / r) >= abs(total / r) - 2.220446049250313e-14 then 1.0 else 0.0 end), 6) as p_value from f, t group by n_blocks"""


# Reweighted means, a hundred times from the median.
_HUBER = """xs as (select list(delta) as x, median(delta) as m from d), sc as (select x, m, 1.4826 * list_median(list_transform(x, lambda v: abs(v - m))) as s from xs),
hb as (select case when s < 1e-8 then m else list_reduce(list_prepend(m, list_transform(range(100), lambda i: i::double)), lambda mu, i:
  list_sum(list_transform(x, lambda v: v * least(1.0, 1.345 * s / greatest(abs(v - mu), 1e-300)))) / list_sum(list_transform(x, lambda v: least(1.0, 1.345 * s / greatest(abs(v - mu), 1e-300))))) end as huber from sc)"""

_CFG = """cs as (select fold, 'c' || (event_id % 4) as config, avg(case when (score >= 0.5)::int = y then 1.0 else 0.0 end) as value from pred group by all),
ct as (select config, avg(value) as mean, stddev_samp(value) as sd, count(*) as n, stddev_samp(value) / sqrt(count(*)) as se from cs group by config)"""

ORACLES = {
    "calibration_curve": f"with {EV} select cast(greatest(1, ceil(score * 10)) as integer) as bin, count(*) as n, round(avg(score), 6) as mean_pred, round(avg(y), 6) as obs_rate, round(min(score), 6) as lo, round(max(score), 6) as hi from ev group by 1",
    "calibration_ece_mce": f"""with {EV}, c as (select greatest(1, ceil(score * 10)) as bin, count(*) as n, abs(avg(score) - avg(y)) as gap from ev group by 1)
select round(sum(n * gap) / sum(n), 6) as ece, round(max(gap), 6) as mce, (select round(avg(pow(y - score, 2)), 6) from ev) as brier, cast(sum(n) as bigint) as n from c""",
    "confounder_sensitivity": f"""with {EV}, q as (select quantile_cont(x, 0.25) as a, quantile_cont(x, 0.5) as b, quantile_cont(x, 0.75) as c from ev),
l as (select 'event_type' as confounder, event_type as level, y, score from ev union all select 'x', 'q' || (1 + (x > a)::int + (x > b)::int + (x > c)::int), y, score from ev, q),
m as (select confounder, level, y, rank() over (partition by confounder, level order by score) + (count(*) over (partition by confounder, level, score) - 1) / 2.0 as r from l)
select confounder, level, count(*) as n, round(avg(y), 6) as positive_rate, round((sum(r) filter (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0), 6) as value from m group by confounder, level""",
    "fold_balance": f"with {PRED} select fold, cast(y as varchar) as level, count(*) as n, round(count(*) / sum(count(*)) over (partition by fold), 6) as share from pred group by fold, y",
    "perm_histogram": f"""with {EV}, s as (select min(x) as lo, max(x) as hi from ev), b as (select cast(least(floor((x - lo) / ((hi - lo) / 12)), 11) as integer) + 1 as bin, lo, hi from ev, s)
select bin, round(max(lo) + (bin - 1) * ((max(hi) - max(lo)) / 12), 6) as lo, round(max(lo) + bin * ((max(hi) - max(lo)) / 12), 6) as hi, count(*) as n from b group by bin""",
    "pred_acf": f"""with {EV}, o as (select row_number() over (order by ts, event_id) as i, score - (select avg(score) from ev) as d from ev), t as (select sum(d * d) as t, count(*) as n from o)
select cast(lag as integer) as lag, round(sum(a.d * b.d) / max(t.t), 6) as acf, round(1.96 / sqrt(max(t.n)), 6) as bound from (select unnest(range(0, 11)) as lag), o a join o b on b.i = a.i + lag, t group by lag""",
    "repeat_weighted_mean": f"with {EV}, {_REP5} select repeat_id, round(sum(n * value) / sum(n), 6) as mean, count(*) as folds from a group by repeat_id",
    "delta_paired": f"with {EV}, {_REP5} select repeat_id, round(leaky, 6) as leaky, round(guarded, 6) as guarded, round(delta, 6) as delta from d",
    "signflip_exact": f"with {EV}, {_REP5}, {_flip(1)}",
    "signflip_blocked_exact": f"with {EV}, {_REP5}, {_flip(2)}",
    "delta_huber": f"with {EV}, {_REP5}, {_HUBER} select round(huber, 6) as huber from hb",
    "delta_full": f"with {EV}, {_REP5}, {_HUBER}, pv as ({_flip(1, False)}) select round(huber, 6) as robust, p_value, 'C' as tier, true as paired from hb, pv",
    "block_size_ar1": f"""with {EV}, {_REP5}, l as (select delta as x, lag(delta) over (order by repeat_id) as p from d), r as (select greatest(0, coalesce(corr(x, p), 0)) as rho, count(*) as n from l)
select round(rho, 6) as rho, case when n < 4 then 1 else greatest(1, least(case when rho >= 0.99 then n else cast(ceil(1 / (1 - rho)) as bigint) end, greatest(n // 3, 1))) end as block_size from r""",
    "pairing_check": f"""with {EV}, g as (select user_id, r as repeat_id, row_number() over (partition by r order by md5('1|split|' || r || '|' || user_id), user_id) - 1 as k from (select distinct user_id from ev), (select unnest([1, 2]) as r)),
f as (select ev.event_id, repeat_id, k % 5 + 1 as fa, k % 4 + 1 as fb from ev join g using (user_id)),
x as (select repeat_id, fa as fold, list(event_id order by event_id) as s from f group by all), z as (select repeat_id, fb as fold, list(event_id order by event_id) as s from f group by all)
select coalesce(x.repeat_id, z.repeat_id) as repeat_id, cast(coalesce(x.fold, z.fold) as integer) as fold, coalesce(x.s = z.s, false) as same from x full join z on x.repeat_id = z.repeat_id and x.fold = z.fold""",
    "threshold_select": f"""with {PRED}, c as (select fold, t as threshold, count(*) filter (y = 1 and score >= t)::double as tp, count(*) filter (y = 1 and score < t)::double as fn, count(*) filter (y = 0 and score >= t)::double as fp from pred, (select unnest([0.1::double, 0.25::double, 0.5::double, 0.75::double]) as t) group by fold, t),
f as (select fold, threshold, 2 * tp / (2 * tp + fp + fn) as value from c)
select fold, threshold, round(value, 6) as value from f qualify row_number() over (partition by fold order by value desc, round(abs(threshold - 0.5), 9), threshold) = 1""",
    "config_table": f"with {PRED}, {_CFG} select config, round(mean, 6) as mean, round(sd, 6) as sd, n, round(se, 6) as se from ct",
    "config_select_one_se": f"""with {PRED}, {_CFG}, pm as (select * from (values ('c0', 1.0, 3), ('c1', 2.0, 2), ('c2', 3.0, 1), ('c3', 4.0, 4)) v(config, penalty, depth)),
top as (select mean, se from ct order by mean desc, config desc limit 1),
nr as (select ct.config, ct.mean, rank() over (order by penalty desc) + rank() over (order by depth) as simple from ct join pm on pm.config = ct.config, top where ct.mean >= top.mean - coalesce(top.se, 0))
select config, round(mean, 6) as mean from nr order by simple, config limit 1""",
    "param_aggregate": f"with {EV} select round(median(x), 6) as x, round(median(score), 6) as score, (select event_type from ev group by event_type order by count(*) desc, event_type limit 1) as event_type from ev",
    "stream_monitor": f"""with {EV} select epoch_us(date_trunc('day', ts)) as start_us, cast(greatest(1, ceil(score * 10)) as integer) as bin, count(*) as n, round(avg(score), 6) as mean_pred, round(avg(y), 6) as obs_rate from ev group by 1, 2""",
}
