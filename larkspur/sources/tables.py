"""Feature tables, outcomes and metadata taken from a DataFrame, and side tables matched by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.errors import ColumnError, FallbackWarning, InputError, signal, warn
from larkspur.ids import need_columns


def features(df: DataFrame, id_col: str, exclude: list[str] = ()) -> DataFrame:
    """id and the columns that can be predictors: all but the id and those excluded; nested columns are left out."""
    usable = [f.name for f in df.schema if f.name != id_col and f.name not in exclude and not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]
    return df.select(id_col, *usable)


def outcome(df: DataFrame, id_col: str, column: str | tuple[str, str]) -> DataFrame:
    """id and y; a pair of columns gives a struct of time and event (1: observed)."""
    if isinstance(column, tuple):
        need_columns(df, *column)
        return df.select(id_col, F.struct(F.col(column[0]).cast("double").alias("time"), F.col(column[1]).cast("int").alias("event")).alias("y"))
    if column not in df.columns:
        raise ColumnError(f"no such column: {column}")
    return df.select(id_col, F.col(column).alias("y"))


def metadata(df: DataFrame, id_col: str, columns: list[str | None]) -> DataFrame:
    return df.select(id_col, *[c for c in dict.fromkeys(columns) if c and c in df.columns])


def aligned(df: DataFrame, side: DataFrame, id_col: str, strict: bool = True) -> DataFrame:
    """df with the side table's columns, whatever either's order. Strict: every row has exactly one match there; else rows without one get nulls, and a warning tells how many."""
    clash = [c for c in side.columns if c != id_col and c in df.columns]
    joined = df.join(side.drop(*clash), id_col, "inner" if strict else "left")
    n, m = df.count(), joined.count()
    if n != m:
        raise InputError(f"{n} rows, {m} after matching {id_col}")
    if not strict and (lost := df.join(side, id_col, "left_anti").count()):
        warn(f"{lost} rows without a match by {id_col}", FallbackWarning)
    return joined


def positive_class(y: str, positive) -> Column:
    """1 for the positive class, 0 for others, null for null."""
    return F.when(F.col(y).isNotNull(), (F.col(y) == F.lit(positive)).cast("int"))


def class_weights(df: DataFrame, y: str, weights: dict) -> DataFrame:
    """df with weight, by class; every class of the data needs one."""
    table = df.sparkSession.createDataFrame([(str(k), float(v)) for k, v in weights.items()], "__y string, weight double")
    missing = df.select(F.col(y).cast("string").alias("__y")).where("__y is not null").distinct().join(table, "__y", "left_anti").limit(5).collect()
    if missing:
        raise InputError(f"no weight for {[r['__y'] for r in missing]}")
    return df.join(F.broadcast(table), F.col(y).cast("string") == F.col("__y"), "left").drop("__y")


def probabilities(df: DataFrame, levels: list[str]) -> Column:
    """An array of class probabilities in the order of levels, from columns named .pred_<level> or <level>, or else as many .pred_ columns by place."""
    named = [next((c for c in (f".pred_{v}", v) if c in df.columns), None) for v in levels]
    if None in named:
        named = [c for c in df.columns if c.startswith(".pred_") and c != ".pred_class"]
        if len(named) != len(levels):
            raise InputError("probability columns that don't match the classes")
    return F.array(*[F.col(f"`{c}`").cast("double") for c in named])


def check_pipeline(stages: list, strict: bool = False) -> None:
    """Stages that were fitted before the split, and leads (lags below zero) in SQL statements, leak; both are signalled."""
    import re

    from pyspark.ml.base import Model

    for stage in stages:
        if isinstance(stage, Model):
            signal(f"{type(stage).__name__} is fitted already: give its estimator", strict)
        text = stage.getStatement() if hasattr(stage, "getStatement") else ""
        if text and re.search(r"\blead\s*\(|\blag\s*\([^,)]*,\s*-", text, re.IGNORECASE):
            signal("a statement looks ahead of its row", strict)
