"""Guarded preprocessing over events: x loses every seventh value; train rows are those whose id 5 doesn't divide."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import guard as G
from larkspur.plans.common import EV, events, rounded

PLAIN = {"winsorize": False, "impute": "median", "normalize": "none"}


def holed(spark, sf):
    e = events(spark, sf)
    return e.select("event_id", "event_type", "y", "score", F.when(F.col("event_id") % 7 != 0, F.col("x")).alias("x"), F.col("user_id").cast("double").alias("u"), F.concat(F.lit("g"), F.col("event_id") % 3).alias("g"))


def train_of(df):
    return df.where("event_id % 5 != 0")


def fitted(spark, sf, numeric=("x", "score", "u"), categorical=(), **config):
    df = holed(spark, sf)
    return G.fit(train_of(df), list(numeric), list(categorical), G.GuardConfig(**(PLAIN | config)), y="y", id_col="event_id"), df


def guard_winsorize(spark, sf):
    model, df = fitted(spark, sf, ["x"], winsorize=True, winsor_k=2.0)
    return rounded(model.transform(df, ["event_id"]), "x")


def guard_impute_median(spark, sf):
    model, df = fitted(spark, sf)
    return rounded(model.transform(df, ["event_id"]), "x", "score", "u")


def guard_missing_indicator(spark, sf):
    model, df = fitted(spark, sf, ["x"], impute="none")
    return rounded(model.transform(df, ["event_id"]), "x", "x__missing")


def guard_zscore_train_only(spark, sf):
    model, df = fitted(spark, sf, normalize="zscore")
    return rounded(model.transform(df, ["event_id"]), "x", "score", "u")


def guard_robust_scale(spark, sf):
    model, df = fitted(spark, sf, normalize="robust")
    return rounded(model.transform(df, ["event_id"]), "x", "score", "u")


def guard_full_chain(spark, sf):
    model, df = fitted(spark, sf, ["x", "score"], winsorize=True, winsor_k=2.0, normalize="zscore")
    return rounded(model.transform(df, ["event_id"]), "x", "score")


def guard_var_iqr_filter(spark, sf):
    df = holed(spark, sf)
    stats = G.column_stats(train_of(df), ["x", "score", "u"])
    kept = G.filtered(stats, G.GuardConfig(var_thresh=0.5, iqr_thresh=1.0))
    rows = [(c, s["var"], s["iqr"], c in kept) for c, s in stats.items()]
    return rounded(spark.createDataFrame(rows, "feature string, variance double, iqr double, keep boolean"), "variance", "iqr")


def guard_ttest_topk(spark, sf):
    return rounded(G.welch(train_of(holed(spark, sf)), ["x", "score", "u"], "y"), "t")


def guard_onehot(spark, sf):
    df = holed(spark, sf)
    _, levels = G.ensure_levels(train_of(df), ["event_type", "g"])
    return G.encode(df, ["event_id"], [], ["event_type", "g"], levels)


def guard_level_align(spark, sf):
    df = holed(spark, sf)
    out, _ = G.ensure_levels(df, ["event_type"], {"event_type": ["click", "purchase", "view"]})
    return out.select("event_id", "event_type")


def guard_knn_impute(spark, sf):
    df = holed(spark, sf)
    stats = G.column_stats(df, ["x", "score", "u"])
    return rounded(G.knn_fill(df, ["event_id"], df, ["x", "score", "u"], stats, 5), "x").select("event_id", "x")


def impute_na_counts(spark, sf):
    df = holed(spark, sf).withColumn("part", F.when(F.col("event_id") % 5 != 0, "train").otherwise("test"))
    return G.na_counts(df, ["x", "score", "u"], ["part"])


def guard_pca(spark, sf):
    model, df = fitted(spark, sf, normalize="zscore", select="pca")
    return rounded(model.transform(df, ["event_id"]), "PC1", "PC2", "PC3")


def guard_lasso(spark, sf):
    model, _ = fitted(spark, sf, normalize="zscore", select="lasso")
    return spark.createDataFrame([(c,) for c in model.columns], "feature string")


def guard_missforest(spark, sf):
    model, df = fitted(spark, sf, impute="missforest")
    return rounded(model.transform(df, ["event_id"]), "x")


def guard_design_matrix(spark, sf):
    df = holed(spark, sf).withColumn("one", F.lit(1.0))
    return rounded(G.design_matrix(train_of(df), df, "event_id", ["x", "score", "one"], ["g"])[1], "x", "score")


def class_weights(spark, sf):
    from larkspur.sources.tables import class_weights as weigh

    return weigh(events(spark, sf).select("event_id", "y"), "y", {0: 2.0, 1: 0.5})


def survival_outcome(spark, sf):
    from larkspur.sources.tables import outcome

    return rounded(outcome(events(spark, sf), "event_id", ("x", "y")).select("event_id", "y.time", "y.event"), "time")


def aligned_metadata(spark, sf):
    from larkspur.sources.tables import aligned, metadata

    e = events(spark, sf)
    return aligned(e.select("event_id", "score"), metadata(e, "event_id", ["user_id", None, "event_type"]), "event_id")


QUERIES = {f.__name__: f for f in (
    guard_winsorize, guard_impute_median, guard_missing_indicator, guard_zscore_train_only, guard_robust_scale, guard_full_chain, guard_var_iqr_filter, guard_ttest_topk, guard_onehot, guard_level_align, guard_knn_impute, impute_na_counts,
    guard_design_matrix, class_weights, survival_outcome, aligned_metadata, guard_pca, guard_lasso, guard_missforest,
)}

_H = rf"""{EV}, h as (select event_id, event_type, y, score, case when event_id % 7 <> 0 then x end as x, user_id::double as u, 'g' || (event_id % 3) as g from ev),
t as (select * from h where event_id % 5 <> 0)"""
_MED = "m as (select " + ", ".join(f"median({c}) as {c}" for c in ("x", "score", "u")) + " from t)"
_FILLED = f"{_MED}, f as (select event_id, y, coalesce(h.x, m.x) as x, h.score, h.u from h, m), ft as (select * from f where event_id % 5 <> 0)"

ORACLES = {
    "guard_winsorize": f"""with {_H}, m as (select median(x) as m from t), a as (select median(abs(t.x - m.m)) as a from t, m),
w as (select event_id, case when x is not null then least(greatest(x, m - 2 * a), m + 2 * a) end as x from h, m, a),
wm as (select median(x) as wm from w where event_id % 5 <> 0)
select event_id, round(coalesce(x, wm), 6) as x from w, wm""",
    "guard_impute_median": f"with {_H}, {_FILLED} select event_id, round(x, 6) as x, round(score, 6) as score, round(u, 6) as u from f",
    "guard_missing_indicator": f"with {_H}, {_FILLED} select h.event_id, round(f.x, 6) as x, case when h.x is null then 1.0::double else 0.0::double end as x__missing from h join f on h.event_id = f.event_id",
    "guard_zscore_train_only": f"""with {_H}, {_FILLED}, s as (select avg(x) as mx, stddev_samp(x) as sx, avg(score) as ms, stddev_samp(score) as ss, avg(u) as mu, stddev_samp(u) as su from ft)
select event_id, round((x - mx) / sx, 6) as x, round((score - ms) / ss, 6) as score, round((u - mu) / su, 6) as u from f, s""",
    "guard_robust_scale": f"""with {_H}, {_FILLED}, s as (select median(x) as mx, median(score) as ms, median(u) as mu from ft),
a as (select median(abs(x - mx)) * 1.4826 as sx, median(abs(score - ms)) * 1.4826 as ss, median(abs(u - mu)) * 1.4826 as su from ft, s)
select event_id, round((x - mx) / sx, 6) as x, round((score - ms) / ss, 6) as score, round((u - mu) / su, 6) as u from f, s, a""",
    "guard_full_chain": f"""with {_H}, m as (select median(x) as mx, median(score) as ms from t), a as (select median(abs(x - mx)) as ax, median(abs(score - ms)) as asc_ from t, m),
w as (select event_id, case when x is not null then least(greatest(x, mx - 2 * ax), mx + 2 * ax) end as x, least(greatest(score, ms - 2 * asc_), ms + 2 * asc_) as score from h, m, a),
wm as (select median(x) as wx from w where event_id % 5 <> 0), f as (select event_id, coalesce(x, wx) as x, score from w, wm),
s as (select avg(x) as cx, stddev_samp(x) as sx, avg(score) as cs, stddev_samp(score) as ss from f where event_id % 5 <> 0)
select event_id, round((x - cx) / sx, 6) as x, round((score - cs) / ss, 6) as score from f, s""",
    "guard_var_iqr_filter": f"""with {_H}, l as (select 'x' as feature, x as v from t union all select 'score', score from t union all select 'u', u from t),
s as (select feature, var_samp(v) as variance, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) as iqr from l group by feature)
select feature, round(variance, 6) as variance, round(iqr, 6) as iqr, variance >= 0.5 and iqr >= 1.0 as keep from s""",
    "guard_ttest_topk": f"""with {_H}, l as (select 'x' as feature, y, x as v from t union all select 'score', y, score from t union all select 'u', y, u from t),
s as (select feature, (avg(v) filter (y = 1) - avg(v) filter (y = 0)) / sqrt(var_samp(v) filter (y = 1) / (count(v) filter (y = 1)) + var_samp(v) filter (y = 0) / (count(v) filter (y = 0))) as t from l where v is not null group by feature)
select feature, round(t, 6) as t, cast(row_number() over (order by abs(t) desc, feature) as integer) as rank from s""",
    "guard_onehot": f"""with {_H} select event_id, {", ".join(f"(event_type = '{v}')::int::double as event_type{v}" for v in ("click", "error", "purchase", "signup", "view"))},
(g = 'g1')::int::double as gg1, (g = 'g2')::int::double as gg2 from h""",
    "guard_level_align": f"with {_H} select event_id, case when event_type in ('click', 'purchase', 'view') then event_type end as event_type from h",
    "guard_knn_impute": f"""with {_H}, m as (select median(x) as mx, stddev_samp(x) as sx, stddev_samp(score) as ss, stddev_samp(u) as su from h),
f as (select event_id, h.x is null as hole, coalesce(h.x, mx) as x, coalesce(h.x, mx) / sx as a, score / ss as b, u / su as c from h, m),
d as (select q.event_id, r.event_id as rid, r.x, round((r.a - q.a) * (r.a - q.a) + (r.b - q.b) * (r.b - q.b) + (r.c - q.c) * (r.c - q.c), 9) as d from f q join f r on q.hole and q.event_id <> r.event_id),
n as (select event_id, x from d qualify row_number() over (partition by event_id order by d, rid) <= 5),
g as (select event_id, avg(x) as x from n group by event_id)
select f.event_id, round(coalesce(g.x, f.x), 6) as x from f left join g on g.event_id = f.event_id""",
    "guard_design_matrix": f"with {_H} select event_id, round(coalesce(x, 0), 6) as x, round(score, 6) as score, (g = 'g0')::int::double as gg0, (g = 'g1')::int::double as gg1, (g = 'g2')::int::double as gg2 from h",
    "class_weights": f"with {EV} select event_id, y, case when y = 1 then 0.5::double else 2.0::double end as weight from ev",
    "survival_outcome": f"with {EV} select event_id, round(x, 6) as time, y as event from ev",
    "aligned_metadata": f"with {EV} select event_id, score, user_id, event_type from ev",
    "impute_na_counts": f"""with {_H}, p as (select case when event_id % 5 <> 0 then 'train' else 'test' end as part, * from h)
select part, 'x' as feature, count(*) as n, count(*) - count(x) as n_missing from p group by part union all select part, 'score', count(*), count(*) - count(score) from p group by part union all select part, 'u', count(*), count(*) - count(u) from p group by part""",
}
