"""Row identity, hash-keyed randomness, and ranks and running sums without a single task.

Random orders are the order of ``md5(seed|purpose|...|key)``: the same for any
partitioning, and the same in any engine that has md5. Global ranks and sums
are made in two levels: rows fall into value buckets, the buckets' totals
(a small table) give each bucket's offset, and a window ranks within a bucket.
Buckets are of equal width for tables that one task could sort, and cut at
quantiles beyond, so that outliers don't leave all others in one bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.errors import ColumnError, InputError

HASH_DIGITS = 3  # 4096 buckets of hash order
VALUE_BUCKETS = 1024
SORT_ROWS = 1_000_000  # that one task sorts at most without cuts at quantiles


def need_columns(df: DataFrame, *columns: str | None) -> None:
    """Each named column exists and holds no null."""
    names = [c for c in columns if c]
    if missing := [c for c in names if c not in df.columns]:
        raise ColumnError(f"no such column: {', '.join(missing)}")
    if names:
        found = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"c{i}") for i, c in enumerate(names)]).first()
        if bad := [c for i, c in enumerate(names) if found[i]]:
            raise ColumnError(f"nulls in {', '.join(bad)}")


def need_unique(df: DataFrame, id_col: str) -> None:
    """Ids are given, and each is of one row."""
    if id_col not in df.columns:
        raise ColumnError(f"no such column: {id_col}")
    if df.groupBy(id_col).count().where(F.col(id_col).isNull() | (F.col("count") > 1)).limit(1).count():
        raise InputError(f"{id_col} isn't unique, or holds nulls")


def hash_order(seed: int, purpose: str, *parts: Column | str) -> Column:
    """A text whose order is random, the same for the same parts."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(purpose), *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]))


def hash_ranked(df: DataFrame, by: list[str], order: Column, *ties: str, name: str = "rn") -> DataFrame:
    """df with the rank (from 1) of each row within by, by a hash order and then ties.

    The first hash digits deal rows into buckets, so no task holds all rows of
    a large group.
    """
    keyed = df.withColumns({"__h": order}).withColumn("__b", F.substring("__h", 1, HASH_DIGITS))
    counts = keyed.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    own = F.row_number().over(Window.partitionBy(*by, "__b").orderBy("__h", *ties))
    return keyed.join(offsets, [*by, "__b"]).withColumn(name, own + F.col("__o")).drop("__h", "__b", "__o")


def running(df: DataFrame, by: list[str], value: str, sums: dict[str, str], *ties: str) -> DataFrame:
    """df with running sums (this row included) within by, in rising order of a numeric column, then ties.

    sums: new column -> column to sum. Rows must be distinct in by, value and ties.
    """
    keyed = _value_buckets(df, value)
    totals = keyed.groupBy(*by, "__b").agg(*[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "__b", *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in sums])
    upto = Window.partitionBy(*by, "__b").orderBy(value, *ties).rowsBetween(Window.unboundedPreceding, 0)
    out = keyed.join(offsets, [*by, "__b"]).withColumns({n: F.sum(c).over(upto) + F.col(f"__o_{n}") for n, c in sums.items()})
    return out.drop("__b", *[f"__o_{n}" for n in sums])


def _value_buckets(df: DataFrame, value: str) -> DataFrame:
    """df with __b, rising with value."""
    number = F.col(value).cast("double")
    bounds = df.agg(F.min(number).alias("lo"), F.max(number).alias("hi"), F.count(F.lit(1)).alias("n")).first()
    if bounds["n"] <= SORT_ROWS:
        width = (bounds["hi"] - bounds["lo"]) if bounds["lo"] is not None else 0.0
        share = (number - F.lit(bounds["lo"] or 0.0)) / F.lit(width or 1.0)
        return df.withColumn("__b", F.least(F.floor(share * VALUE_BUCKETS), F.lit(VALUE_BUCKETS - 1)).cast("int"))
    from pyspark.ml.feature import Bucketizer

    keyed = df.withColumn("__v", number)
    cuts = keyed.approxQuantile("__v", [i / VALUE_BUCKETS for i in range(1, VALUE_BUCKETS)], 0.25 / VALUE_BUCKETS)
    splits = [float("-inf"), *sorted({c for c in cuts if abs(c) != float("inf")}), float("inf")]
    return Bucketizer(splits=splits, inputCol="__v", outputCol="__b", handleInvalid="keep").transform(keyed).withColumn("__b", F.col("__b").cast("int")).drop("__v")


def value_ranked(df: DataFrame, by: list[str], value: str, *ties: str, name: str = "rn") -> DataFrame:
    """df with the rank (from 1) within by, by a numeric column and then ties."""
    return running(df.withColumn("__one", F.lit(1).cast("long")), by, value, {name: "__one"}, *ties).drop("__one")
