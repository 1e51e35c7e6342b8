"""What the queries share: the prediction frame made of events, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators.splits import SplitPlan, make_split_plan

DIGITS = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, DIGITS) for c in columns})


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, event_type, ts, x, y, score."""
    e = table(spark, sf_dir, "events")
    score = F.regexp_extract("props", r"(\d+)", 1).cast("double") / 100
    return e.select("event_id", "user_id", "event_type", "ts", F.col("value").alias("x"), (F.col("value") > 20).cast("int").alias("y"), score.alias("score"))


def subject_plan(spark: SparkSession, sf_dir: str, **more) -> SplitPlan:
    return make_split_plan(events(spark, sf_dir), "subject_grouped", id_col="event_id", group="user_id", batch="event_type", outcome="y", check=False, **more)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, event_type, ts, x, y, score, repeat_id, fold."""
    return events(spark, sf_dir).join(subject_plan(spark, sf_dir).assign, "event_id")


EV = r"""ev as (select event_id, user_id, event_type, ts, value as x, case when value > 20 then 1 else 0 end as y,
  cast(regexp_extract(props, '(\d+)', 1) as double) / 100 as score from events)"""
GRP = """grp as (select user_id, cast((row_number() over (order by md5('1|split|1|' || user_id), user_id) - 1) % 5 + 1 as integer) as fold
  from (select distinct user_id from ev))"""
PRED = f"""{EV}, {GRP}, pred as (select ev.*, 1 as repeat_id, grp.fold from ev join grp using (user_id))"""
