"""Sources, column handling, intervals and simulated data, each against SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from larkspur.operators import audit as A
from larkspur.operators import guard as G
from larkspur.operators import metrics as M
from larkspur.operators import permute as P
from larkspur.operators import resample as R
from larkspur.operators import simulate as SIM
from larkspur.operators import uncertainty as U
from larkspur.operators.splits import make_split_plan
from larkspur.plans.common import EV, PRED, events, predictions, rounded, subject_plan, table
from larkspur.sources import tables as S

PLAIN = G.GuardConfig(winsorize=False, normalize="none")


def source_features(spark, sf):
    return S.features(table(spark, sf, "embeddings").join(table(spark, sf, "events").select(F.col("event_id").alias("vec_id"), "value"), "vec_id"), "vec_id", ["label"])


def source_metadata(spark, sf):
    return S.metadata(events(spark, sf), "event_id", ["user_id", None, "event_type", "no such column", "user_id"])


def source_positive_class(spark, sf):
    return events(spark, sf).select("event_id", S.positive_class("event_type", "click").alias("y"))


def source_probabilities(spark, sf):
    """An array of class probabilities from columns named by class."""
    e = events(spark, sf).select("event_id", "event_type", F.col("score").alias(".pred_low"), (1 - F.col("score")).alias("high"))
    return e.select("event_id", F.round(F.element_at(S.probabilities(e, ["low", "high"]), 2), 6).alias("p_high"))


def guard_split_columns(spark, sf):
    """Predictors that are left once the outcome and the split's columns are dropped."""
    names = R.guard_columns(subject_plan(spark, sf), "y", ["event_id", "user_id", "event_type", "ts", "x", "y", "score"])
    return spark.createDataFrame([(i, n) for i, n in enumerate(names)], "place int, name string")


def guard_text_to_number(spark, sf):
    """A text column of plain decimals as numbers, beside one that isn't."""
    o = table(spark, sf, "orders").select("o_orderkey", F.substring("o_orderpriority", 1, 1).alias("level"), F.when(F.col("o_orderkey") % 9 > 0, F.col("o_orderstatus")).alias("status"))
    model = G.fit(o, ["level", "status"], config=PLAIN, id_col="o_orderkey")
    return model.transform(o, ["o_orderkey"])


def guard_nonfinite(spark, sf):
    """NaN and infinities count as missing, and are filled by the train median."""
    k = F.col("event_id") % 5
    e = events(spark, sf).select("event_id", F.when(k == 0, float("nan")).when(k == 1, float("inf")).otherwise(F.col("x")).alias("x"))
    return rounded(G.fit(e, ["x"], config=PLAIN, id_col="event_id").transform(e, ["event_id"]), "x")


def guard_align_columns(spark, sf):
    """New rows without one of the train columns: it is missing there, so filled."""
    e = events(spark, sf).select("event_id", "x", "score")
    return rounded(G.fit(e, ["x", "score"], config=PLAIN, id_col="event_id").transform(e.drop("x").withColumn("other", F.lit(1)), ["event_id"]), "x", "score")


def guard_min_keep(spark, sf):
    """Columns whose variance is too small, but for the best of them that min_keep brings back."""
    e = events(spark, sf).select("event_id", F.col("score").alias("a"), (F.col("score") / 10).alias("b"), (F.col("score") / 100).alias("c"))
    model = G.fit(e, ["a", "b", "c"], config=G.GuardConfig(winsorize=False, normalize="none", var_thresh=1e6, min_keep=2), id_col="event_id")
    return spark.createDataFrame([(i, n) for i, n in enumerate(model.columns)], "place int, name string")


def guard_steps(spark, sf):
    e = events(spark, sf).select("event_id", "x", "score", "event_type")
    return spark.createDataFrame([(s["step"], s["p_in"], s["p_out"]) for s in G.fit(e, ["x", "score"], ["event_type"], id_col="event_id").steps()], "step string, p_in int, p_out int")


def fit_single_class(spark, sf):
    """Folds whose train rows are of one class are skipped: all positives are rows of fold 2."""
    p = predictions(spark, sf).withColumn("z", (F.col("fold") == 2).cast("int")).drop("fold", "repeat_id")
    learner = (lambda x, y, task, w: None, lambda m, x, task: np.zeros(len(x)))
    fit = R.fit_resample(p, "z", subject_plan(spark, sf), "binomial", {"zero": learner}, ["score"], ["accuracy"])
    return fit.fold_status.select("fold", "status", "reason")


def fit_threshold(spark, sf):
    """Classes by a threshold of one's own."""
    learner = (lambda x, y, task, w: None, lambda m, x, task: 1 / (1 + np.exp(-x[:, 0])))
    fit = R.fit_resample(events(spark, sf), "y", subject_plan(spark, sf), "binomial", {"s": learner}, ["score"], ["accuracy"], threshold=0.6)
    return fit.predictions.groupBy("fold", "pred_class").agg(F.count(F.lit(1)).alias("n"))


def cv_interval(spark, sf):
    """Student's interval of the mean fold accuracy."""
    m = M.accuracy(predictions(spark, sf), "y", "score", ["fold"]).withColumn("learner", F.lit("s"))
    r = U.cv_ci(m, ["accuracy"])[0]
    return rounded(spark.createDataFrame([(r["mean"], r["sd"], r["ci_lo"], r["ci_hi"])], "mean double, sd double, lo double, hi double"), "mean", "sd", "lo", "hi")


def gap_interval(spark, sf):
    """Standard error and interval of a gap, from six given permuted values."""
    r = U.se_ci_delta(0.2, 0.03, [0.5, 0.52, 0.48, 0.51, 0.47, 0.5])
    return rounded(spark.createDataFrame([(r["se"], *r["ci"], r["z"])], "se double, lo double, hi double, z double"), "se", "lo", "hi", "z")


def permutation_modes(spark, sf):
    """The permutation scheme that follows from each split's mode."""
    return spark.createDataFrame(sorted((m, P.perm_mode(type("plan", (), {"mode": m}))) for m in P.MODES), "mode string, scheme string")


def duplicates_report(spark, sf):
    """The most similar pairs, capped at a report's length."""
    e = table(spark, sf, "embeddings")
    plan = make_split_plan(e, "subject_grouped", id_col="vec_id", group="label", v=3, check=False)
    return rounded(A.duplicates(e, plan, "embedding", 0.35, scope="all", max_pairs=7).drop("cross_fold"), "sim")


def gap_in_words(spark, sf):
    gaps = [-0.2, 0.0, 0.0099, 0.01, 0.03, 0.05, 0.4]
    return spark.createDataFrame([(g, A.gap_words(g)) for g in gaps], "gap double, words string")


def simulated_features(spark, sf):
    """Simulated rows: their groups, three features, and the share of positives in their subject."""
    df = SIM.simulate_dataset(spark, 300, 3, "subject_overlap", seed=5)
    return rounded(df.select("row_id", "subject", "batch", "study", "x01", "x02", "x03", "y", "leak"), "x01", "x02", "x03", "leak")


def simulated_lookahead(spark, sf):
    df = SIM.simulate_dataset(spark, 200, 2, "lookahead", seed=3)
    return df.select("row_id", "y", "leak")


QUERIES = {f.__name__: f for f in (
    source_features, source_metadata, source_positive_class, source_probabilities, guard_split_columns, guard_text_to_number, guard_nonfinite, guard_align_columns, guard_min_keep, guard_steps, fit_single_class, fit_threshold,
    cv_interval, gap_interval, permutation_modes, duplicates_report, gap_in_words, simulated_features, simulated_lookahead,
)}


def _normal(seed: int, column: str, parts: tuple[str, str] = ("a", "b")) -> str:
    u = lambda part: f"((cast('0x' || substr(md5('{seed}|{part}|' || {column} || row_id), 1, 12) as bigint) + 0.5) / 281474976710656.0)"
    return f"sqrt(-2 * ln({u(parts[0])})) * cos(2 * pi() * {u(parts[1])})"


def _simulated(seed: int, n: int, p: int) -> str:
    names = [f"x{j:02d}" for j in range(1, p + 1)]
    return f"""x as (select row_id, (row_id - 1) % {n // 5} + 1 as subject, (row_id - 1) % 6 + 1 as batch, (row_id - 1) % 4 + 1 as study, {", ".join(f"{_normal(seed, repr(c + '|'))} as {c}" for c in names)} from (select unnest(range(1, {n + 1})) as row_id)),
sim as (select *, case when ({" + ".join(names)}) / sqrt({float(p)}) + {_normal(seed, "''", ("e", "f"))} > 0 then 1 else 0 end as y from x)"""


ORACLES = {
    "source_features": "select vec_id, value from embeddings join events on event_id = vec_id",
    "source_metadata": f"with {EV} select event_id, user_id, event_type from ev",
    "source_positive_class": f"with {EV} select event_id, (event_type = 'click')::int as y from ev",
    "source_probabilities": f"with {EV} select event_id, round(1 - score, 6) as p_high from ev",
    "guard_split_columns": "select * from (values (0::int, 'ts'), (1, 'x'), (2, 'score')) v(place, name)",
    "guard_text_to_number": """with o as (select o_orderkey, cast(left(o_orderpriority, 1) as double) as level, case when o_orderkey % 9 > 0 then o_orderstatus end as s from orders),
f as (select *, count(s) over () < count(*) over () as holes from o)
select o_orderkey, level, coalesce((s = 'F')::int::double, (select median((s = 'F')::int) from o)) as "statusF", coalesce((s = 'O')::int::double, (select median((s = 'O')::int) from o)) as "statusO", coalesce((s = 'P')::int::double, (select median((s = 'P')::int) from o)) as "statusP" from f""",
    "guard_nonfinite": f"with {EV} select event_id, round(case when event_id % 5 < 2 then (select median(x) from ev where event_id % 5 >= 2) else x end, 6) as x from ev",
    "guard_align_columns": f"with {EV} select event_id, cast(null as double) as x, round(score, 6) as score from ev",
    "guard_min_keep": "select * from (values (0::int, 'a'), (1, 'b')) v(place, name)",
    "guard_steps": f"with {EV}, k as (select count(distinct event_type) as k from ev) select s as step, cast(case when s = 'encode' then 3 else 2 + k end as integer) as p_in, cast(2 + k as integer) as p_out from k, (select unnest(['encode', 'winsorize', 'impute', 'normalize', 'filter', 'select']) as s)",
    "fit_single_class": "select cast(f as integer) as fold, case when f = 2 then 'skipped' else 'success' end as status, case when f = 2 then 'single_class_training' else '' end as reason from (select unnest([1, 2, 3, 4, 5]) as f)",
    "fit_threshold": f"""with {PRED}, t as (select f, avg(score) as m, stddev_samp(score) as s from pred, (select unnest([1, 2, 3, 4, 5]) as f) where fold <> f group by f)
select fold, (1 / (1 + exp(-(score - m) / s)) >= 0.6)::int as pred_class, count(*) as n from pred join t on fold = f group by 1, 2""",
    "cv_interval": f"""with {PRED}, a as (select fold, avg(((score >= 0.5)::int = y)::int) as v from pred group by fold)
select round(avg(v), 6) as mean, round(stddev_samp(v), 6) as sd, round(avg(v) - 2.7764451051977987 * stddev_samp(v) / sqrt(5), 6) as lo, round(avg(v) + 2.7764451051977987 * stddev_samp(v) / sqrt(5), 6) as hi from a""",
    "gap_interval": """with v as (select unnest([0.5, 0.52, 0.48, 0.51, 0.47, 0.5]::double[]) as v), s as (select sqrt(0.03 * 0.03 + var_samp(v) / count(*)) as se from v)
select round(se, 6) as se, round(0.2 - 2.5705818356363146 * se, 6) as lo, round(0.2 + 2.5705818356363146 * se, 6) as hi, round(0.2 / se, 6) as z from s""",
    "permutation_modes": "select * from (values ('batch_blocked', 'batch'), ('combined', 'subject'), ('study_loocv', 'study'), ('subject_grouped', 'subject'), ('time_series', 'time')) v(mode, scheme)",
    "duplicates_report": """select a.vec_id as i, b.vec_id as j, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as sim from embeddings a join embeddings b on a.vec_id < b.vec_id
where list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= 0.35 order by list_cosine_similarity(a.embedding::double[], b.embedding::double[]) desc, 1, 2 limit 7""",
    "gap_in_words": "select gap::double as gap, case when gap < 0.01 then 'little' when gap < 0.05 then 'modest' else 'strong' end as words from (select unnest([-0.2, 0.0, 0.0099, 0.01, 0.03, 0.05, 0.4]) as gap)",
    "simulated_features": f"with {_simulated(5, 300, 3)} select row_id, subject, batch, study, round(x01, 6) as x01, round(x02, 6) as x02, round(x03, 6) as x03, y, round(avg(y) over (partition by subject), 6) as leak from sim",
    "simulated_lookahead": f"with {_simulated(3, 200, 2)} select row_id, y, coalesce(lead(y) over (order by row_id), y)::double as leak from sim",
}
