"""Split plans over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import splits as S
from larkspur.plans.common import EV, GRP, PRED, events, subject_plan, table
from larkspur.sources import folds as FO


def split_subject_grouped(spark, sf):
    return subject_plan(spark, sf, repeats=2).assign


def split_subject_stratified(spark, sf):
    return subject_plan(spark, sf, stratify=True).assign


def split_batch_blocked(spark, sf):
    return S.make_split_plan(events(spark, sf), "batch_blocked", id_col="event_id", batch="event_type", v=3, check=False).assign


def split_study_loo(spark, sf):
    return S.make_split_plan(table(spark, sf, "customer"), "study_loocv", id_col="c_custkey", study="c_nationkey", check=False).assign


def split_time_series(spark, sf):
    return S.make_split_plan(events(spark, sf), "time_series", id_col="event_id", time="ts", v=7, check=False).assign


def split_time_purge_embargo(spark, sf):
    return S.make_split_plan(events(spark, sf), "time_series", id_col="event_id", time="ts", v=5, horizon=3600, purge=7200, embargo=86400 * 8, check=False).summary()


def split_combined_exclusion(spark, sf):
    orders = table(spark, sf, "orders").withColumn("four", F.expr("o_orderkey div 4"))
    plan = S.make_split_plan(orders, "combined", id_col="o_orderkey", constraints=["o_custkey", "four"], components=False, check=False)
    return plan.train().groupBy("repeat_id", "fold").agg(F.count(F.lit(1)).alias("train_n"))


def split_combined_dates(spark, sf):
    plan = S.make_split_plan(_dated(spark, sf), "combined", id_col="o_orderkey", constraints=["o_custkey", "day"], components=False, check=False)
    return plan.summary()


def _dated(spark, sf):
    return table(spark, sf, "orders").withColumn("day", F.datediff("o_orderdate", F.lit("1970-01-01")))


def split_components(spark, sf):
    comps = S.constraint_components(table(spark, sf, "customer"), ["c_custkey", "c_nationkey"])
    return comps.groupBy("component").agg(F.count(F.lit(1)).alias("n_levels"))


def split_component_packing(spark, sf):
    li = table(spark, sf, "lineitem").withColumns({"row": F.concat_ws("-", "l_orderkey", "l_linenumber")}).select("row", "l_orderkey", "l_suppkey", F.concat_ws("-", "l_orderkey", F.col("l_suppkey") % 2).alias("axis"))
    plan = S.make_split_plan(li, "combined", id_col="row", constraints=["l_orderkey", "axis"], check=False)
    return plan.assign.groupBy("repeat_id", "fold").agg(F.count(F.lit(1)).alias("test_n"))


def split_nested(spark, sf):
    return S.nested_plan(subject_plan(spark, sf), v=3)


def split_nested_time(spark, sf):
    """Inner blocks of time of each outer time fold's train rows."""
    plan = S.make_split_plan(events(spark, sf), "time_series", id_col="event_id", time="ts", v=4, check=False)
    return S.nested_plan(plan, v=3).groupBy("outer_repeat", "outer_fold", "inner_fold").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("least"), F.max("event_id").alias("most"))


def split_summary(spark, sf):
    return subject_plan(spark, sf).summary()


def split_overlap_check(spark, sf):
    return S.check_split_overlap(subject_plan(spark, sf), ["user_id", "event_type"]).select("repeat_id", "fold", "col", "n_overlap", "pass")


def split_overlap_counts(spark, sf):
    return S.check_split_overlap(subject_plan(spark, sf), ["event_type"]).select("repeat_id", "fold", "n_overlap", "n_train", "n_test")


def split_plan_hash(spark, sf):
    return subject_plan(spark, sf, repeats=2).plan_hash()


def folds_export(spark, sf):
    return FO.export_folds(subject_plan(spark, sf, repeats=2))


def folds_import(spark, sf):
    e = events(spark, sf)
    labels = e.select("event_id", F.concat(F.lit("Repeat"), F.col("event_id") % 2).alias("id"), F.concat(F.lit("Fold"), F.col("event_id") % 3).alias("id2"))
    return FO.import_folds(labels, e.select("event_id", F.col("user_id").alias("subject")), "event_id").assign


def folds_from_spec(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    spec = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("group"))
    return FO.plan_from_spec(orders, spec, "o_orderkey", "subject", check=False).assign


def schema_task_inference(spark, sf):
    from larkspur.functions import tasks

    return tasks.infer_tasks(events(spark, sf).select("y", "x", "event_type", (F.col("event_id") % 4).alias("k")), ["y", "x", "k"])


QUERIES = {f.__name__: f for f in (
    split_subject_grouped, split_subject_stratified, split_batch_blocked, split_study_loo, split_time_series, split_time_purge_embargo, split_combined_exclusion, split_combined_dates, split_components,
    split_component_packing, split_nested, split_nested_time, split_summary, split_overlap_check, split_overlap_counts, split_plan_hash, folds_export, folds_import, folds_from_spec, schema_task_inference,
)}

_REP = """grp as (select user_id, r as repeat_id, cast((row_number() over (partition by r order by md5('1|split|' || r || '|' || user_id), user_id) - 1) % 5 + 1 as integer) as fold
  from (select distinct user_id from ev), (select unnest([1, 2]) as r))"""
_TIMES = """ranked as (select event_id, ts, row_number() over (order by ts, event_id) as rn, count(*) over () as n from ev)"""
_BLOCK = "cast(greatest(1, ((rn - 1) * {v} + n - 2) // (n - 1)) as integer) as fold"


def _combined(axis: str, extra: str = "") -> str:
    return f"""with o as (select *, cast(datediff('day', date '1970-01-01', o_orderdate) as integer) as day from orders),
g as (select o_custkey, cast((row_number() over (order by md5('1|split|1|' || o_custkey), o_custkey) - 1) % 5 + 1 as integer) as fold from (select distinct o_custkey from o)),
a as (select o_orderkey, {axis} as axis, fold from o join g using (o_custkey)),
lv as (select distinct fold, axis from a),
tr as (select a.o_orderkey, f.fold from a join (select distinct fold from a) f on a.fold <> f.fold where not exists (select 1 from lv where lv.fold = f.fold and lv.axis = a.axis)),
trn as (select fold, count(*) as train_n from tr group by fold)"""


ORACLES = {
    "split_subject_grouped": f"with {EV}, {_REP} select event_id, repeat_id, fold from ev join grp using (user_id)",
    "split_subject_stratified": f"""with {EV}, c as (select user_id, y, count(*) as n from ev group by user_id, y),
m as (select user_id, y from c qualify row_number() over (partition by user_id order by n desc, y) = 1),
g as (select user_id, cast((row_number() over (partition by y order by md5('1|split|1|' || user_id), user_id) - 1) % 5 + 1 as integer) as fold from m)
select event_id, 1 as repeat_id, fold from ev join g using (user_id)""",
    "split_batch_blocked": f"""with {EV}, g as (select event_type, cast((row_number() over (order by md5('1|split|1|' || event_type), event_type) - 1) % 3 + 1 as integer) as fold from (select distinct event_type from ev))
select event_id, 1 as repeat_id, fold from ev join g using (event_type)""",
    "split_study_loo": "select c_custkey, 1 as repeat_id, cast(dense_rank() over (order by c_nationkey) as integer) as fold from customer",
    "split_time_series": f"with {EV}, {_TIMES} select event_id, 1 as repeat_id, {_BLOCK.format(v=7)} from ranked",
    "split_time_purge_embargo": f"""with {EV}, {_TIMES}, a as (select event_id, epoch_us(ts) as t, {_BLOCK.format(v=5)} from ranked),
b as (select fold, min(t) as tmin, max(t) as tmax, count(*) as test_n from a group by fold)
select 1 as repeat_id, b.fold, count(*) as train_n, b.test_n from b join a on a.t <= b.tmin - 10800000000 and a.t <= b.tmax - 691200000000 where b.test_n >= 3 group by b.fold, b.test_n""",
    "split_combined_exclusion": f"{_combined('o_orderkey // 4')} select 1 as repeat_id, fold, train_n from trn",
    "split_combined_dates": f"{_combined('day')} select 1 as repeat_id, trn.fold, train_n, test_n from trn join (select fold, count(*) as test_n from a group by fold) t on t.fold = trn.fold",
    "split_component_packing": """with o as (select l_orderkey, row_number() over (order by md5('1|pack|1|' || l_orderkey), cast(l_orderkey as varchar)) - 1 as k from (select distinct l_orderkey from lineitem))
select 1 as repeat_id, cast(k % 5 + 1 as integer) as fold, count(*) as test_n from lineitem join o using (l_orderkey) group by k % 5""",
    "split_components": """with recursive li as (select distinct cast(c_custkey as varchar) as g, c_nationkey as k from customer),
e as (select distinct a.g as x, b.g as y from li a join li b on a.k = b.k),
reach(g, c) as (select distinct g, g from li union select e.y, reach.c from reach join e on reach.g = e.x),
m as (select g, min(c) as component from reach group by g)
select component, count(*) as n_levels from m group by component""",
    "split_nested": f"""with {EV}, {GRP}, tr as (select ev.event_id, ev.user_id, f.fold as outer_fold from ev join grp using (user_id) join (select distinct fold from grp) f on f.fold <> grp.fold),
g as (select outer_fold, user_id, cast((row_number() over (partition by outer_fold order by md5('2|inner|1|' || outer_fold || '|' || user_id), user_id) - 1) % 3 + 1 as integer) as inner_fold from (select distinct outer_fold, user_id from tr))
select 1 as outer_repeat, outer_fold, event_id, inner_fold from tr join g using (outer_fold, user_id)""",
    "split_nested_time": f"""with {EV}, {_TIMES}, bl as (select event_id, ts, {_BLOCK.format(v=4)} from ranked), st as (select fold, min(ts) as t0 from bl group by fold),
tr as (select st.fold as outer_fold, event_id, row_number() over (partition by st.fold order by ts, event_id) as rn, count(*) over (partition by st.fold) as n from bl join st on bl.ts < st.t0)
select 1 as outer_repeat, outer_fold, {_BLOCK.format(v=3).replace("as fold", "as inner_fold")}, count(*) as n, min(event_id) as least, max(event_id) as most from tr group by 2, 3""",
    "split_summary": f"with {PRED} select 1 as repeat_id, fold, (select count(*) from pred) - count(*) as train_n, count(*) as test_n from pred group by fold",
    "split_overlap_check": f"""with {PRED}, l as (select fold, 'user_id' as col, cast(user_id as varchar) as level from pred union all select fold, 'event_type', event_type from pred),
d as (select distinct fold, col, level from l), f as (select distinct fold from pred),
o as (select f.fold, d.col, d.level, max(case when d.fold = f.fold then 1 else 0 end) as te, max(case when d.fold <> f.fold then 1 else 0 end) as tr from f, d group by f.fold, d.col, d.level)
select 1 as repeat_id, fold, col, cast(sum(te * tr) as bigint) as n_overlap, sum(te * tr) = 0 as pass from o group by fold, col""",
    "split_overlap_counts": f"""with {PRED}, d as (select distinct fold, event_type from pred), f as (select distinct fold from pred),
o as (select f.fold, d.event_type, max(case when d.fold = f.fold then 1 else 0 end) as te, max(case when d.fold <> f.fold then 1 else 0 end) as tr from f, d group by all)
select 1 as repeat_id, fold, cast(sum(te * tr) as bigint) as n_overlap, cast(sum(tr) as bigint) as n_train, cast(sum(te) as bigint) as n_test from o group by fold""",
    "split_plan_hash": f"""with {EV}, {_REP}, h as (select repeat_id, md5(fold || '|' || event_id) as h from ev join grp using (user_id)),
s as (select repeat_id, sum(cast('0x' || substr(h, 1, 8) as bigint)) as a, sum(cast('0x' || substr(h, 9, 8) as bigint)) as b, sum(cast('0x' || substr(h, 17, 8) as bigint)) as c, sum(cast('0x' || substr(h, 25, 8) as bigint)) as d, count(*) as n from h group by repeat_id)
select repeat_id, sha256(concat_ws('|', a, b, c, d, n)) as plan_hash from s""",
    "folds_export": f"""with {EV}, {_REP}, a as (select event_id, repeat_id, fold from ev join grp using (user_id))
select event_id, 'Repeat' || repeat_id as id, 'Fold' || fold as id2, 'test' as role from a
union all select a.event_id, 'Repeat' || a.repeat_id, 'Fold' || f.fold, 'train' from a join (select distinct repeat_id, fold from a) f on f.repeat_id = a.repeat_id and f.fold <> a.fold""",
    "folds_import": """with l as (select event_id, 'Repeat' || (event_id % 2) as id, 'Fold' || (event_id % 3) as id2 from events)
select event_id, cast(dense_rank() over (order by id) as integer) as repeat_id, cast(dense_rank() over (partition by id order by id2) as integer) as fold from l""",
    "folds_from_spec": """with g as (select o_custkey, cast((row_number() over (order by md5('1|split|1|' || o_custkey), o_custkey) - 1) % 5 + 1 as integer) as fold from (select distinct o_custkey from orders))
select o_orderkey, 1 as repeat_id, fold from orders join g using (o_custkey)""",
    "schema_task_inference": f"""with {EV} select 'y' as col, count(distinct y) as n_levels, 'binomial' as task from ev
union all select 'x', count(distinct x), 'gaussian' from ev union all select 'k', count(distinct event_id % 4), 'gaussian' from ev""",
}
