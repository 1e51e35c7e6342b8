"""Permutations of labels as joins of two ranks.

A permuted label is the label of the row whose hash rank equals a row's id
rank, within the same cell. The permutation number is a column; ranks are made
without a single task (ids.hash_ranked).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.errors import FallbackWarning, InputError, warn
from larkspur.functions.columns import Stored
from larkspur.functions.hashing import Texts
from larkspur.ids import hash_order, hash_ranked, value_ranked
from larkspur.operators.splits import SplitPlan, as_number

MODES = {"subject_grouped": "subject", "batch_blocked": "batch", "study_loocv": "study", "time_series": "time", "combined": "subject"}


def perm_mode(plan: SplitPlan | None, override: str | None = None) -> str:
    """global, subject, batch, study or time: the plan's, unless given."""
    if override:
        if override not in ("global", "subject", "batch", "study", "time"):
            raise InputError("unknown permutation mode")
        return override
    if plan is None:
        raise InputError("a foreign split needs an explicit permutation mode")
    return MODES[plan.mode]


def _draws(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(n))))


def _seeded(seed: int, purpose: str, *parts) -> Column:
    """A hash order that differs by b: the seed of permutation b is seed + b."""
    return F.md5(F.concat_ws("|", (F.col("b") + seed).cast("string"), F.lit(purpose), *[F.col(p).cast("string") for p in parts]))


def draws(df: DataFrame, id_col: str, label: str, n: int, seed: int = 1, cells: list[str] = ()) -> DataFrame:
    """(b, cells, i, label): the label that permutation b brings to place i."""
    slim = df.select(id_col, label, *cells)
    return hash_ranked(_draws(slim, n), ["b", *cells], _seeded(seed, "perm", id_col), id_col, name="i").select("b", *cells, "i", label)


def places(df: DataFrame, id_col: str, cells: list[str] = (), *keep: str) -> DataFrame:
    """(cells, i, id, keep): the place of each row, by id."""
    slim, cells = df.select(id_col, *cells, *keep), list(cells)
    ranked = value_ranked(slim, cells, id_col, name="i") if _is_number(df, id_col) else hash_ranked(slim, cells, F.lpad(F.col(id_col).cast("string"), 24, "0"), id_col, name="i")
    return ranked.select(*cells, "i", id_col, *keep)


def place_order(df: DataFrame, id_col: str) -> Column:
    """What places() orders by, before the id itself."""
    return F.col(id_col) if _is_number(df, id_col) else F.lpad(F.col(id_col).cast("string"), 24, "0")


def draw_prefix(seed: int, b: int) -> bytes:
    """What precedes an id in the text whose hash orders permutation b of draws()."""
    return f"{b + seed}|perm|".encode()


def texts_of(held: Stored) -> Texts:
    out = Texts()
    for batch in held.batches("text"):
        out.add(batch.column(0))
    return out


def numbered(spark: SparkSession, first: int, last: int) -> DataFrame:
    """(b): the numbers of permutations, a few to a task."""
    return spark.range(first, last + 1, 1, max(1, min(last + 1 - first, 3 * spark.sparkContext.defaultParallelism))).select(F.col("id").cast("int").alias("b"))


def shuffled(df: DataFrame, id_col: str, label: str, n: int, seed: int = 1, cells: list[str] = ()) -> DataFrame:
    """(b, id, label): n permutations of the label, within cells if any are given."""
    cells = list(cells)
    return draws(df, id_col, label, n, seed, cells).join(places(df, id_col, cells), [*cells, "i"]).select("b", id_col, label)


def _is_number(df: DataFrame, c: str) -> bool:
    return df.schema[c].dataType.typeName() in ("long", "integer", "short", "double", "float")


def subject_blocks(df: DataFrame, id_col: str, subject: str, label: str, n: int, seed: int = 1, stratum: str | None = None) -> DataFrame:
    """(b, id, label): the labels of subjects with equally many rows (in the same stratum) change places as blocks; those of the others are shuffled among themselves, row by row."""
    own = Window.partitionBy(subject).orderBy(id_col)
    rows = df.select(id_col, subject, label, *([stratum] if stratum else [])).withColumn("k", F.row_number().over(own))
    agg = [F.count(F.lit(1)).alias("size")] + ([F.mode(stratum, deterministic=True).alias("st")] if stratum else [F.lit(0).alias("st")])
    subjects = df.groupBy(subject).agg(*agg)
    peers = subjects.groupBy("size", "st").agg(F.count(F.lit(1)).alias("peers"))
    sized = subjects.join(peers, ["size", "st"])
    swap = sized.where("peers > 1").drop("peers")
    place = value_ranked(swap.withColumn("one", F.lit(0)), ["size", "st"], "one", subject, name="i").drop("one")
    drawn = hash_ranked(_draws(swap, n), ["b", "size", "st"], _seeded(seed, "block", subject), subject, name="i").withColumnRenamed(subject, "donor")
    moved = drawn.join(place, ["size", "st", "i"]).select("b", subject, "donor")
    donors = rows.select(F.col(subject).alias("donor"), "k", label)
    blocks = rows.select(id_col, subject, "k").join(moved, subject).join(donors, ["donor", "k"]).select("b", id_col, label)
    alone = sized.where("peers = 1").select(subject)
    rest = df.join(alone, subject, "left_semi")
    return blocks.unionByName(shuffled(rest, id_col, label, n, seed))


def time_ordered(df: DataFrame, id_col: str, time: str, label: str) -> DataFrame:
    """(id, label, i): i is the place in time, from 1, ties by id."""
    number = as_number(F.col(time), df.schema[time].dataType.typeName())
    return value_ranked(df.select(id_col, label, number.alias("__t")), [], "__t", id_col, name="i").drop("__t")


def circular_blocks(df: DataFrame, id_col: str, time: str, label: str, n: int, seed: int = 1, length: int | None = None) -> DataFrame:
    """(b, id, label): blocks of the time order from random starts, wrapped at the end, one after another; with replacement. The default length is max(5, n / 10)."""
    total = df.count()
    length = max(5, total // 10) if length is None else length
    ordered = time_ordered(df, id_col, time, label)
    block = F.expr(f"(i - 1) div {length}")
    start = F.conv(F.substring(F.md5(F.concat_ws("|", (F.col("b") + seed).cast("string"), F.lit("circular"), F.col("block").cast("string"))), 1, 12), 16, 10).cast("long") % total
    asked = _draws(ordered.select(id_col, "i", block.alias("block")), n).withColumn("src", (start + F.expr(f"(i - 1) % {length}")) % total + 1)
    return asked.select("b", id_col, "src").join(ordered.select(F.col("i").alias("src"), label), "src").select("b", id_col, label)


def stationary(df: DataFrame, id_col: str, time: str, label: str, n: int, seed: int = 1, mean_block: float | None = None) -> DataFrame:
    """(b, id, label): blocks of geometric length; a row starts one with probability 1 / mean_block, at a random place; with replacement.

    The last start before each row is carried by a two-level running maximum.
    """
    total = df.count()
    mean_block = max(5, total // 10) if mean_block is None else max(1.0, mean_block)
    ordered = time_ordered(df, id_col, time, label)
    word = lambda at: F.conv(F.substring(F.col("h"), at, 12), 16, 10).cast("long")
    drawn = _draws(ordered.select(id_col, "i"), n).withColumn("h", _seeded(seed, "stationary", "i"))
    begins = (F.col("i") == 1) | (word(1) < F.lit(int(2**48 / mean_block)))
    marked = drawn.select("b", id_col, "i", F.when(begins, F.col("i")).alias("at"), F.when(begins, word(13) % total).alias("start"), F.expr("(i - 1) div 4096").alias("part"))
    last = marked.where("at is not null").groupBy("b", "part").agg(F.max_by(F.struct("at", "start"), "at").alias("last"))
    parts = marked.select("b", "part").distinct().join(last, ["b", "part"], "left")
    carried = parts.withColumn("prior", F.last("last", ignorenulls=True).over(Window.partitionBy("b").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("b", "part", "prior")
    own = F.last(F.when(F.col("at").isNotNull(), F.struct("at", "start")), ignorenulls=True).over(Window.partitionBy("b", "part").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    found = marked.withColumn("own", own).join(carried, ["b", "part"]).withColumn("from", F.coalesce("own", "prior"))
    src = (F.col("from.start") + F.col("i") - F.col("from.at")) % total + 1
    return found.select("b", id_col, src.alias("src")).join(ordered.select(F.col("i").alias("src"), label), "src").select("b", id_col, label)


def quantile_strata(df: DataFrame, column: str, bins: int = 4, least: int = 20) -> DataFrame:
    """df with stratum: the quantile bin (from 1, closed at the right) of a number; one stratum with a warning for under ``least`` values."""
    if df.where(F.col(column).isNotNull()).limit(least).count() < least:
        warn(f"under {least} values: no strata are made", FallbackWarning)
        return df.withColumn("stratum", F.lit(1))
    cuts = sorted(set(df.agg(F.percentile(column, F.array(*[F.lit(i / bins) for i in range(1, bins)]))).first()[0]))
    return df.withColumn("stratum", sum([(F.col(column) > c).cast("int") for c in cuts], F.lit(1)))


def permuted_labels(df: DataFrame, id_col: str, label: str, n: int, mode: str = "global", seed: int = 1, subject: str | None = None, batch: str | None = None, study: str | None = None, time: str | None = None, strata: list[str] = (), block: str = "circular", length: int | None = None) -> DataFrame:
    """(b, id, label) by mode; strata refine the cells of global, batch and study."""
    if mode == "subject":
        return subject_blocks(df, id_col, subject, label, n, seed, strata[0] if strata else None)
    if mode == "time":
        return (circular_blocks if block == "circular" else stationary)(df, id_col, time, label, n, seed, length)
    cells = {"global": [], "batch": [batch], "study": [study]}[mode]
    return shuffled(df, id_col, label, n, seed, [*cells, *strata])
