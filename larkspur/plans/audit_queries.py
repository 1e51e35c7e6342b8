"""Permutations and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import audit as A
from larkspur.operators import permute as P
from larkspur.operators.splits import make_split_plan
from larkspur.plans.common import EV, PRED, events, predictions, rounded, subject_plan, table

B = 5  # of the queries that SQL repeats
PERMUTATIONS = 200  # audit_leakage's default; p <= 0.05 needs 19 at least


def perm_gap_auc(spark, sf):
    g = A.gap_table(predictions(spark, sf), "event_id", "auc", "binomial", B, "y", "score")
    return rounded(g, "metric_obs", "perm_mean", "perm_sd", "gap", "p_value")


def perm_gap_rmse(spark, sf):
    p = predictions(spark, sf).withColumn("p", F.col("score") * 100)
    return rounded(A.gap_table(p, "event_id", "rmse", "gaussian", B, "x", "p"), "metric_obs", "perm_mean", "perm_sd", "gap", "p_value")


def perm_gap_by_learner(spark, sf):
    p = predictions(spark, sf)
    two = p.select(F.col("event_id").alias("row"), F.lit("a").alias("learner"), "y", "score").unionAll(p.select(F.col("event_id") + 10_000_000, F.lit("b"), "y", F.col("x") / 1000))
    return rounded(A.gaps_by_learner(two, "row", B, 1, "y", "score"), "metric_obs", "perm_mean", "gap")


def perm_within_batch(spark, sf):
    return P.permuted_labels(events(spark, sf), "event_id", "y", 2, "batch", batch="event_type")


def perm_subject_blocks(spark, sf):
    return P.permuted_labels(events(spark, sf), "event_id", "y", 2, "subject", subject="user_id")


def perm_circular_block(spark, sf):
    return P.permuted_labels(events(spark, sf), "event_id", "x", 2, "time", time="ts", length=37)


def perm_stationary(spark, sf):
    return P.permuted_labels(events(spark, sf), "event_id", "x", 2, "time", time="ts", block="stationary", length=25)


def perm_strata(spark, sf):
    return P.quantile_strata(events(spark, sf), "x").groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))


def assoc_batch_fold(spark, sf):
    return rounded(A.batch_assoc(subject_plan(spark, sf), events(spark, sf), ["event_type", "y"]), "stat", "cramer_v")


def assoc_yates_2x2(spark, sf):
    e = events(spark, sf).withColumn("half", (F.col("score") >= 0.5).cast("int"))
    return rounded(A.chisq_assoc(e, "half", "y", ["event_type"]), "stat", "cramer_v")


def target_scan_auc(spark, sf):
    e = events(spark, sf).withColumn("u", F.col("user_id"))
    return rounded(A.scan_numeric_binary(e, ["x", "score", "u"], "y"), "value", "score", "z")


def target_scan_cor(spark, sf):
    li = table(spark, sf, "lineitem")
    return rounded(A.scan_numeric_numeric(li, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice"), "value", "score", "t")


def target_scan_eta_sq(spark, sf):
    li = table(spark, sf, "lineitem")
    return rounded(A.scan_numeric_classes(li, ["l_quantity", "l_discount", "l_extendedprice"], "l_returnflag"), "value", "score", "f")


def target_scan_eta_sq_categorical(spark, sf):
    return rounded(A.scan_categorical_numeric(events(spark, sf), ["event_type", "user_id"], "x"), "value", "score", "f")


def target_scan_cramer_v(spark, sf):
    return rounded(A.scan_categorical_classes(events(spark, sf), ["event_type", "user_id"], "y"), "value", "score", "stat")


def _pvalues(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_nationkey", "c_custkey", (F.pmod(F.col("c_custkey") * 7919, F.lit(1009)) / 1009.0).alias("p_value"))


def p_adjust_bh(spark, sf):
    return rounded(A.p_adjust(_pvalues(spark, sf), "p_value", "BH", ["c_nationkey"]), "p_value", "p_value_adj")


def p_adjust_by(spark, sf):
    return rounded(A.p_adjust(_pvalues(spark, sf), "p_value", "BY", ["c_nationkey"]), "p_value", "p_value_adj")


def p_adjust_holm(spark, sf):
    return rounded(A.p_adjust(_pvalues(spark, sf), "p_value", "holm", ["c_nationkey"]), "p_value", "p_value_adj")


def p_adjust_bonferroni(spark, sf):
    return rounded(A.p_adjust(_pvalues(spark, sf), "p_value", "bonferroni", ["c_nationkey"]), "p_value", "p_value_adj")


def near_duplicates_cosine(spark, sf):
    return rounded(A.near_duplicates(table(spark, sf, "embeddings"), "vec_id", "embedding", 0.4), "sim")


def near_duplicates_pearson(spark, sf):
    return rounded(A.near_duplicates(table(spark, sf, "embeddings"), "vec_id", "embedding", 0.4, "pearson"), "sim")


def near_duplicates_rank(spark, sf):
    return rounded(A.near_duplicates(table(spark, sf, "embeddings"), "vec_id", "embedding", 0.87, "cosine", "rank"), "sim")


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "embedding", F.col("label").alias("group"), (F.col("vec_id") * 7 % 1000).alias("t"))


def duplicates_cross_fold(spark, sf):
    v = _vectors(spark, sf)
    plan = make_split_plan(v, "subject_grouped", id_col="vec_id", group="group", v=3, check=False)
    return rounded(A.cross_fold(A.near_duplicates(v, "vec_id", "embedding", 0.4), plan), "sim")


def duplicates_time_cross(spark, sf):
    v = _vectors(spark, sf)
    plan = make_split_plan(v, "time_series", id_col="vec_id", time="t", v=4, horizon=10, check=False)
    return rounded(A.cross_fold(A.near_duplicates(v, "vec_id", "embedding", 0.4), plan), "sim")


def mechanism_summary(spark, sf):
    plan = subject_plan(spark, sf)
    gap = A.gap_table(predictions(spark, sf), "event_id", "auc", "binomial", PERMUTATIONS, "y", "score").first().asDict()
    batch = A.with_pvalues(A.batch_assoc(plan, events(spark, sf), ["event_type"]))
    scan = A.target_scan(events(spark, sf), "y", "binomial", ["x", "score"], adjust="none")
    v = _vectors(spark, sf)
    vplan = make_split_plan(v, "subject_grouped", id_col="vec_id", group="group", v=3, check=False)
    dups = A.cross_fold(A.near_duplicates(v, "vec_id", "embedding", 0.4), vplan)
    rows = [(r["mechanism_class"], r["flagged"], r["evidence"], None if r["statistic"] is None else round(float(r["statistic"]), 6)) for r in A.mechanism_summary(gap, batch, scan, dups, plan.mode)]
    return spark.createDataFrame(rows, "mechanism_class string, flagged boolean, evidence string, statistic double")


def target_scan_multivariate(spark, sf):
    li = events(spark, sf).withColumns({"u": F.col("user_id").cast("double"), "s2": F.col("score") * F.col("score")})
    r = A.multivariate_scan(li, ["score", "u", "s2"], "y", "event_id", subject_plan(spark, sf), "binomial")
    return spark.createDataFrame([(r["metric"], r["value"], r["score"], r["p_value"], r["n"], r["n_components"], r["n_interactions"])], "metric string, value double, score double, p_value double, n long, n_components int, n_interactions int")


def audit_full(spark, sf):
    p = predictions(spark, sf).select("event_id", "fold", F.col("y").alias("truth"), F.col("score").alias("pred"))
    a = A.audit_leakage(p, subject_plan(spark, sf), "auc", "binomial", PERMUTATIONS, samples=events(spark, sf), features=["score"], outcome="y", batch_columns=["event_type"])
    return spark.createDataFrame([(m["mechanism_class"], m["flagged"]) for m in a.mechanisms], "mechanism_class string, flagged boolean")


QUERIES = {f.__name__: f for f in (
    perm_gap_auc, perm_gap_rmse, perm_gap_by_learner, perm_within_batch, perm_subject_blocks, perm_circular_block, perm_stationary, perm_strata, assoc_batch_fold, assoc_yates_2x2, target_scan_auc, target_scan_cor,
    target_scan_eta_sq, target_scan_eta_sq_categorical, target_scan_cramer_v, p_adjust_bh, p_adjust_by, p_adjust_holm, p_adjust_bonferroni, near_duplicates_cosine, near_duplicates_pearson, near_duplicates_rank,
    duplicates_cross_fold, duplicates_time_cross, mechanism_summary, target_scan_multivariate, audit_full,
)}

_SERIES = f"(select unnest(range(1, {B + 1})) as b)"


def _shuffle(label: str, n: int, cells: str = "", source: str = "pred") -> str:
    part = f"{cells}, " if cells else ""
    own = f"partition by {cells} " if cells else ""
    return f"""place as (select event_id, {part}row_number() over ({own}order by event_id) as i from {source}),
draw as (select b, {part}{label}, row_number() over (partition by {part}b order by md5((b + 1) || '|perm|' || event_id), event_id) as i from {source}, (select unnest(range(1, {n + 1})) as b)),
perm as (select b, event_id, {label} from draw join place using ({part}i))"""


def _auc_of(source: str, by: str) -> str:
    return f"""select {by}, (sum(r) filter (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) as value
from (select {by}, y, rank() over (partition by {by} order by score) + (count(*) over (partition by {by}, score) - 1) / 2.0 as r from {source}) group by {by}"""


_GAP = f"""o as ({_auc_of("(select 0 as b, y, score from pred)", "b")}),
v as ({_auc_of("(select perm.b, perm.y, pred.score from perm join pred using (event_id))", "b")}),
g as (select max(o.value) as metric_obs, avg(v.value) as perm_mean, stddev_samp(v.value) as perm_sd, max(o.value) - avg(v.value) as gap, (1.0 + count(*) filter (v.value >= o.value)) / (1.0 + count(*)) as p_value, count(*) as n_perm from v, o)"""


def _chi(source: str, a: str, b: str, by: str) -> str:
    return f"""cell as (select {by}, {a} as a, {b} as b, count(*)::double as o from {source} group by all),
dense as (select r.{by}, r.a, c.b, r.n * c.n / t.n as e, coalesce(cell.o, 0) as o, t.n
  from (select {by}, a, sum(o) as n from cell group by all) r join (select {by}, b, sum(o) as n from cell group by all) c on r.{by} = c.{by} join (select {by}, sum(o) as n from cell group by all) t on t.{by} = r.{by}
  left join cell on cell.{by} = r.{by} and cell.a = r.a and cell.b = c.b),
k as (select {by}, count(distinct a) as ka, count(distinct b) as kb, max(n) as n, sum((o - e) * (o - e) / e) as q, sum(pow(abs(o - e) - least(0.5, abs(o - e)), 2) / e) as yq from dense group by {by}),
chi as (select {by}, case when ka < 2 or kb < 2 then null when ka = 2 and kb = 2 then yq else q end as stat, cast((ka - 1) * (kb - 1) as bigint) as df, n, ka, kb from k),
assoc as (select {by}, stat, df, sqrt(stat / (n * (least(ka, kb) - 1))) as cramer_v, cast(n as bigint) as n from chi)"""


_LONG3 = "l as (select 'x' as feature, y, x as v from ev union all select 'score', y, score from ev union all select 'u', y, user_id from ev)"


def _eta(long: str, value: str, level: str) -> str:
    return f"""{long}, gm as (select feature, avg({value}) as m, count(*) as n, count(distinct {level}) as k, sum({value} * {value}) - count(*) * avg({value}) * avg({value}) as total from l group by feature),
bw as (select feature, sum(n * (lm - m) * (lm - m)) as between_ from (select l.feature, l.{level}, count(*) as n, avg(l.{value}) as lm, max(gm.m) as m from l join gm on gm.feature = l.feature group by l.feature, l.{level}) group by feature),
wi as (select l.feature, sum((l.{value} - c.lm) * (l.{value} - c.lm)) as within_ from l join (select feature, {level}, avg({value}) as lm from l group by all) c on c.feature = l.feature and c.{level} = l.{level} group by l.feature)
select gm.feature, 'eta_sq' as metric, round(between_ / (between_ + within_), 6) as value, round(between_ / (between_ + within_), 6) as score, round(between_ / (k - 1) / (within_ / (n - k)), 6) as f, k - 1 as d1, n - k as d2, n
from gm join bw on bw.feature = gm.feature join wi on wi.feature = gm.feature"""


_PV = "pv as (select c_nationkey, c_custkey, ((c_custkey * 7919) % 1009) / 1009.0::double as p_value from customer), rk as (select *, row_number() over (partition by c_nationkey order by p_value, c_custkey) as r, count(*) over (partition by c_nationkey) as m from pv)"


def _padj(expr: str) -> str:
    return f"with {_PV} select c_nationkey, c_custkey, round(p_value, 6) as p_value, round(least(1.0, {expr}), 6) as p_value_adj from rk"


def _sim(v: str) -> str:
    return f"""x as (select vec_id, list_transform(embedding, lambda e: e::double) as raw from embeddings), c as (select vec_id, {v} as v from x),
p as (select a.vec_id as i, b.vec_id as j, list_cosine_similarity(a.v, b.v) as sim from c a join c b on a.vec_id < b.vec_id)"""


_G3 = """s as (select vec_id, label as grp, vec_id * 7 % 1000 as t from embeddings),
g as (select grp, cast((row_number() over (order by md5('1|split|1|' || grp), grp) - 1) % 3 + 1 as integer) as fold from (select distinct grp from s)),
f as (select vec_id, fold from s join g using (grp))"""

ORACLES = {
    "perm_gap_auc": f"with {PRED}, {_shuffle('y', B)}, {_GAP} select round(metric_obs, 6) as metric_obs, round(perm_mean, 6) as perm_mean, round(perm_sd, 6) as perm_sd, round(gap, 6) as gap, round(p_value, 6) as p_value, n_perm from g",
    "perm_gap_rmse": f"""with {PRED}, {_shuffle('x', B)}, o as (select sqrt(avg(pow(x - score * 100, 2))) as value from pred),
v as (select perm.b, sqrt(avg(pow(perm.x - pred.score * 100, 2))) as value from perm join pred using (event_id) group by perm.b)
select round(max(o.value), 6) as metric_obs, round(avg(v.value), 6) as perm_mean, round(stddev_samp(v.value), 6) as perm_sd, round(avg(v.value) - max(o.value), 6) as gap, round((1.0 + count(*) filter (v.value <= o.value)) / (1.0 + count(*)), 6) as p_value, count(*) as n_perm from v, o""",
    "perm_gap_by_learner": f"""with {PRED}, two as (select event_id, 'a' as learner, y, score from pred union all select event_id + 10000000, 'b', y, x / 1000 from pred), {_shuffle('y', B, 'learner', 'two')},
o as ({_auc_of('two', 'learner')}), v as ({_auc_of("(select perm.b || '|' || two.learner as k, perm.y, two.score from perm join two using (event_id))", 'k')}),
m as (select split_part(k, '|', 2) as learner, avg(value) as perm_mean from v group by 1)
select o.learner, round(o.value, 6) as metric_obs, round(m.perm_mean, 6) as perm_mean, round(o.value - m.perm_mean, 6) as gap from o join m on m.learner = o.learner""",
    "perm_within_batch": f"with {EV}, {_shuffle('y', 2, 'event_type', 'ev')} select cast(b as integer) as b, event_id, y from perm",
    "perm_subject_blocks": f"""with {EV}, r as (select event_id, user_id, y, row_number() over (partition by user_id order by event_id) as k from ev),
s as (select user_id, count(*) as size from ev group by user_id), pr as (select *, count(*) over (partition by size) as peers from s),
pl as (select user_id, size, row_number() over (partition by size order by user_id) as i from pr where peers > 1),
dr as (select b, size, user_id as donor, row_number() over (partition by b, size order by md5((b + 1) || '|block|' || user_id), user_id) as i from pr, (select unnest([1, 2]) as b) where peers > 1),
mv as (select dr.b, pl.user_id, dr.donor from dr join pl using (size, i)),
blk as (select mv.b, r.event_id, d.y from mv join r using (user_id) join r d on d.user_id = mv.donor and d.k = r.k),
rest as (select ev.* from ev join pr using (user_id) where peers = 1), {_shuffle('y', 2, '', 'rest')}
select cast(b as integer) as b, event_id, y from blk union all select cast(b as integer), event_id, y from perm""",
    "perm_circular_block": f"""with {EV}, o as (select event_id, x, row_number() over (order by ts, event_id) as i, count(*) over () as n from ev),
a as (select b, event_id, (cast('0x' || substr(md5((b + 1) || '|circular|' || ((i - 1) // 37)), 1, 12) as bigint) % n + (i - 1) % 37) % n + 1 as src from o, (select unnest([1, 2]) as b))
select cast(a.b as integer) as b, a.event_id, o.x from a join o on o.i = a.src""",
    "perm_stationary": f"""with {EV}, o as (select event_id, x, row_number() over (order by ts, event_id) as i, count(*) over () as n from ev),
h as (select b, event_id, i, n, md5((b + 1) || '|stationary|' || i) as h from o, (select unnest([1, 2]) as b)),
m as (select b, event_id, i, n, case when i = 1 or cast('0x' || substr(h, 1, 12) as bigint) < {int(2**48 / 25)} then i end as at_, case when i = 1 or cast('0x' || substr(h, 1, 12) as bigint) < {int(2**48 / 25)} then cast('0x' || substr(h, 13, 12) as bigint) % n end as start_ from h),
c as (select b, event_id, i, n, last_value(at_ ignore nulls) over w as at_, last_value(start_ ignore nulls) over w as start_ from m window w as (partition by b order by i rows unbounded preceding))
select cast(c.b as integer) as b, c.event_id, o.x from c join o on o.i = (c.start_ + c.i - c.at_) % c.n + 1""",
    "perm_strata": f"""with {EV}, q as (select quantile_cont(x, 0.25) as a, quantile_cont(x, 0.5) as b, quantile_cont(x, 0.75) as c from ev)
select cast(1 + (x > a)::int + (x > b)::int + (x > c)::int as integer) as stratum, count(*) as n from ev, q group by 1""",
    "assoc_batch_fold": f"""with {PRED}, l as (select 'event_type' as batch_col, fold, event_type as level from pred union all select 'y', fold, cast(y as varchar) from pred), {_chi('l', 'fold', 'level', 'batch_col')}
select batch_col, 1 as repeat_id, round(stat, 6) as stat, df, round(cramer_v, 6) as cramer_v from assoc""",
    "assoc_yates_2x2": f"with {EV}, {_chi('ev', '(score >= 0.5)::int', 'y', 'event_type')} select event_type, round(stat, 6) as stat, df, round(cramer_v, 6) as cramer_v, n from assoc",
    "target_scan_auc": f"""with {EV}, {_LONG3}, m as (select feature, y, v, rank() over (partition by feature order by v) + (count(*) over (partition by feature, v) - 1) / 2.0 as r from l),
t as (select feature, sum(n * n * n - n) as ties from (select feature, count(*)::double as n from l group by feature, v) group by feature),
u as (select feature, sum(r) filter (y = 1) - sum(y) * (sum(y) + 1) / 2.0 as u, sum(y)::double as a, (count(*) - sum(y))::double as b, count(*) as n from m group by feature)
select u.feature, 'auc' as metric, round(u / (a * b), 6) as value, round(abs(u / (a * b) - 0.5) * 2, 6) as score, round((u - a * b / 2 - sign(u - a * b / 2) * 0.5) / sqrt(a * b / 12 * (n + 1 - ties / (n * (n - 1.0)))), 6) as z, n from u join t on t.feature = u.feature""",
    "target_scan_cor": """with l as (select 'l_quantity' as feature, l_quantity as v, l_extendedprice as y from lineitem union all select 'l_discount', l_discount, l_extendedprice from lineitem union all select 'l_tax', l_tax, l_extendedprice from lineitem),
c as (select feature, corr(v, y) as r, count(*) as n from l group by feature)
select feature, 'cor' as metric, round(r, 6) as value, round(abs(r), 6) as score, round(r * sqrt((n - 2) / (1 - r * r)), 6) as t, n from c""",
    "target_scan_eta_sq": "with " + _eta("l as (select 'l_quantity' as feature, l_quantity as v, l_returnflag as lev from lineitem union all select 'l_discount', l_discount, l_returnflag from lineitem union all select 'l_extendedprice', l_extendedprice, l_returnflag from lineitem)", "v", "lev"),
    "target_scan_eta_sq_categorical": f"with {EV}, " + _eta("l as (select 'event_type' as feature, x as v, event_type as lev from ev union all select 'user_id', x, cast(user_id as varchar) from ev)", "v", "lev"),
    "target_scan_cramer_v": f"""with {EV}, l as (select 'event_type' as feature, event_type as level, y from ev union all select 'user_id', cast(user_id as varchar), y from ev), {_chi('l', 'level', 'y', 'feature')}
select feature, 'cramer_v' as metric, round(cramer_v, 6) as value, round(cramer_v, 6) as score, round(stat, 6) as stat, df, n from assoc""",
    "p_adjust_bh": _padj("min(p_value * m / r) over (partition by c_nationkey order by r rows between current row and unbounded following)"),
    "p_adjust_by": _padj("min(p_value * m / r * list_sum(list_transform(range(1, m + 1), lambda i: 1.0::double / i))) over (partition by c_nationkey order by r rows between current row and unbounded following)"),
    "p_adjust_holm": _padj("max(p_value * (m - r + 1)) over (partition by c_nationkey order by r rows unbounded preceding)"),
    "p_adjust_bonferroni": _padj("p_value * m"),
    "near_duplicates_cosine": f"with {_sim('raw')} select i, j, round(sim, 6) as sim from p where sim >= 0.4",
    "near_duplicates_pearson": f"with {_sim('list_transform(raw, lambda e: e - list_avg(raw))')} select i, j, round(sim, 6) as sim from p where sim >= 0.4",
    "near_duplicates_rank": """with x as (select vec_id, k, embedding[k]::double as e from embeddings, (select unnest(range(1, 65)) as k) where k <= len(embedding)),
r as (select vec_id, k, rank() over (partition by k order by e) + (count(*) over (partition by k, e) - 1) / 2.0 as r from x),
c as (select vec_id, list(r order by k) as v from r group by vec_id)
select a.vec_id as i, b.vec_id as j, round(list_cosine_similarity(a.v, b.v), 6) as sim from c a join c b on a.vec_id < b.vec_id where list_cosine_similarity(a.v, b.v) >= 0.87""",
    "duplicates_cross_fold": f"with {_sim('raw')}, {_G3} select i, j, round(sim, 6) as sim, a.fold <> b.fold as cross_fold from p join f a on a.vec_id = i join f b on b.vec_id = j where sim >= 0.4",
    "duplicates_time_cross": f"""with {_sim('raw')}, s as (select vec_id, vec_id * 7 % 1000 as t from embeddings),
o as (select vec_id, t, row_number() over (order by t, vec_id) as rn, count(*) over () as n from s), f as (select vec_id, t, greatest(1, ((rn - 1) * 4 + n - 2) // (n - 1)) as fold from o),
st as (select fold, min(t) as m from f group by fold)
select i, j, round(sim, 6) as sim, b.t <= sa.m - 10 or a.t <= sb.m - 10 as cross_fold from p join f a on a.vec_id = i join f b on b.vec_id = j join st sa on sa.fold = a.fold join st sb on sb.fold = b.fold where sim >= 0.4""",
}
