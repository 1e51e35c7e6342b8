"""Outcome kinds, told from a column's type and values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.errors import InputError

LEVELS = 2  # distinct values that are looked at beyond 0 and 1


def _numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, (T.NumericType, T.BooleanType))


def infer_tasks(df: DataFrame, outcomes: list[str], factors: tuple[str, ...] = ()) -> DataFrame:
    """(col, n_levels, task), in one pass.

    Numbers whose values are exactly 0 and 1 are binomial, other numbers
    gaussian. Text is an outcome only where it is named a factor: binomial with
    two levels, multiclass with more.
    """
    for c in outcomes:
        if not _numeric(df, c) and c not in factors:
            raise InputError(f"{c} is text: name it a factor to use it as classes")
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("v"), F.lit(c in factors).alias("factor"), (F.col(c).cast("double").isin(0.0, 1.0) if _numeric(df, c) else F.lit(False)).alias("unit")) for c in outcomes])).alias("s")).select("s.*")
    levels = long.where("v is not null").groupBy("col", "v", "factor", "unit").agg(F.count(F.lit(1)).alias("n"))
    out = levels.groupBy("col", "factor").agg(F.count(F.lit(1)).alias("n_levels"), F.min("unit").alias("unit"))
    task = F.when(F.col("factor") & (F.col("n_levels") > 2), "multiclass").when(F.col("factor") | (F.col("unit") & (F.col("n_levels") == 2)), "binomial").otherwise("gaussian")
    return out.select("col", "n_levels", task.alias("task"))


def infer_task(df: DataFrame, outcome: str | tuple[str, str], factor: bool = False) -> str:
    """binomial, multiclass, gaussian, or survival for a pair of columns (time, event)."""
    if isinstance(outcome, tuple):
        return "survival"
    rows = infer_tasks(df, [outcome], (outcome,) if factor else ()).collect()
    if not rows or (factor and rows[0]["n_levels"] < 2):
        raise InputError(f"{outcome} has fewer than two values")
    if df.where(F.col(outcome).isNull()).limit(1).count() and rows[0]["task"] != "gaussian":
        raise InputError(f"nulls in {outcome}")
    return rows[0]["task"]
