"""Mixing sources to target weights by temperature.

A source's share of the tokens, raised to an exponent and normalised, is its
weight: 1 keeps the shares, 0 makes all sources equal. The exponent is the
smallest in [0, 1] that keeps to a repetition limit (no source is read more
than limit times as often as the one read least), or the one whose weights
have a target entropy. It is bisected by DataFrame aggregates, 32 ways a round.

A budget of tokens, dealt by weight, is realised by whole permutations of each
source's documents and a part of one more, cut at the budget: documents are
dealt into about sqrt(n) blocks by hash, blocks are ordered by hash, the blocks
that fit go in whole, and the documents of the one block on the edge are
ordered by hash and go in while they fit. No window holds more than the blocks
of a source or the documents of a block. Without a budget, the one is taken
that gives the source read least exactly one permutation, so that every
document is read.

DataFrame functions only. Defined results: a null source is a source of its
own; null and empty texts have no tokens, and go in wherever their place in
the permutation is reached; repeated rows (same id and text) go in together;
a source without tokens is read once; an empty table gives an empty one.
Other columns, whatever their names, are carried along.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.storage import few, gathered, sized, written

REPEAT_LIMIT = 2.0
ROW = 256  # bytes of a row with a source's name, where it is broadcast
WAYS, ROUNDS = 32, 7  # 32**-7 is below 1e-10


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0)).cast("long")


def _measures(totals: DataFrame, exponents: list[float]) -> list[tuple]:
    """(exponent, entropy of its weights in nats, largest over smallest repetition), by exponent."""
    a = F.explode(F.array(*[F.lit(x) for x in exponents])).alias("a")
    p = F.col("p")
    rows = totals.select("p", a).groupBy("a").agg(
        F.sum(F.pow(p, F.col("a"))).alias("z"), F.sum(F.pow(p, F.col("a")) * F.log(p)).alias("zl"), F.max(F.pow(p, F.col("a") - 1)).alias("hi"), F.min(F.pow(p, F.col("a") - 1)).alias("lo")
    )
    return [(r["a"], math.log(r["z"]) - r["a"] * r["zl"] / r["z"], r["hi"] / r["lo"]) for r in rows.orderBy("a").collect()]


def exponent_for(totals: DataFrame, limit: float | None = None, entropy: float | None = None) -> float:
    """The exponent that meets the target. totals: p, the positive shares. Targets out of reach give the end of the range."""
    if (limit is None) == (entropy is None):
        raise ValueError("give a repetition limit or an entropy")
    lo, hi = 0.0, 1.0  # both measures fall as the exponent rises
    for _ in range(ROUNDS):
        grid = [lo + (hi - lo) * i / WAYS for i in range(WAYS + 1)]
        met = [a for a, h, r in _measures(totals, grid) if (r <= limit * (1 + 1e-12) if limit is not None else h <= entropy)]
        if not met:
            return 1.0
        hi = min(met)
        lo = max([a for a in grid if a < hi], default=hi)
        if lo == hi:
            break
    return hi


def _order(seed: int, *parts: Column | str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]))


def mix(df: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text", limit: float | None = REPEAT_LIMIT, entropy: float | None = None, budget: int | None = None, seed: int = 17, added: tuple[str, str] = ("n_tokens", "epoch")) -> DataFrame:
    """All columns of df, then its number of tokens and the epoch: each document once for each permutation that it goes in with.

    Columns of df that are named as the added ones are replaced.
    """
    inner = {c: f"c{i}" for i, c in enumerate(df.columns)}  # no internal name is like these
    given, df = df, df.toDF(*inner.values())
    source, key, text = inner[source], inner[key], inner[text]
    names = [i for c, i in inner.items() if c not in added]
    docs = df.select(*names, *{i for i in (source, key, text) if i not in names}, word_count(F.col(text)).alias("n_tokens"), F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n")).alias("__s"), F.xxhash64(F.col(key).cast("string"), F.col(text)).alias("__rk"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("__t"), F.col(key).alias("__k"))
    slim = written(sized(docs.select("__s", "__k", "__t", "__rk", "n_tokens"), given), "mix-rows")
    totals = written(gathered(slim.groupBy("__s").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("docs"))), "mix-totals")
    whole = totals.agg(F.sum("n").alias("n")).first()["n"] or 0
    positive = totals.where("n > 0").withColumn("p", F.col("n") / F.lit(float(max(whole, 1))))
    a = exponent_for(positive, limit, entropy) if whole else 1.0
    weighed = positive.withColumn("w", F.pow("p", F.lit(a)))
    z, most = weighed.agg(F.sum("w"), F.max(F.col("n") / F.col("w"))).first()
    tokens = float(budget) if budget is not None else (most or 0.0) * (z or 0.0)
    quota = F.round(F.col("w") / F.lit(z or 1.0) * F.lit(tokens)).cast("long")
    plan = weighed.withColumn("quota", quota).select("__s", F.expr("quota div n").alias("__full"), F.expr("quota % n").alias("__rest"), F.ceil(F.sqrt("docs")).cast("long").alias("__nb"))
    plan = written(plan.unionAll(totals.where("n = 0").select("__s", F.lit(1).cast("long"), F.lit(0).cast("long"), F.lit(1).cast("long"))), "mix-plan")
    block = F.conv(F.substring(_order(seed, "__s", "__k", "__t"), 1, 8), 16, 10).cast("long") % F.col("__nb")
    dealt = slim.join(few(plan, ROW), "__s").withColumn("__b", block)
    blocks = dealt.groupBy("__s", "__b").agg(F.sum("n_tokens").alias("t"), F.max("__rest").alias("rest"), F.max("__full").alias("__full"), F.max("__nb").alias("__nb"))
    place = F.sum("t").over(Window.partitionBy("__s").orderBy(_order(seed + 1, "__s", F.col("__full"), F.col("__b")), "__b").rowsBetween(Window.unboundedPreceding, 0))
    # what is left of the budget before a block: the block fits whole, lies on the edge, or comes after it
    reached = blocks.withColumn("left", F.col("rest") - (place - F.col("t")))
    blocks = written(gathered(reached.select("__s", "__b", "__nb", "__full", F.when((F.col("rest") > 0) & (F.col("left") >= F.col("t")), F.lit(-1)).when(F.col("left") > 0, F.col("left")).otherwise(0).cast("long").alias("__left"))), "mix-blocks")
    edge = dealt.drop("__full", "__nb").join(few(blocks.where("__left > 0"), ROW), ["__s", "__b"])
    rows = edge.groupBy("__s", "__b", "__k", "__t", "__rk").agg(F.sum("n_tokens").alias("t"), F.max("__left").alias("left"), F.max("__full").alias("full"))
    upto = F.sum("t").over(Window.partitionBy("__s", "__b").orderBy(_order(seed + 2, F.col("full"), "__k", "__t"), "__rk").rowsBetween(Window.unboundedPreceding, 0))
    chosen = written(gathered(rows.withColumn("upto", upto).where("upto <= left").select("__rk").distinct()), "mix-edge").withColumn("__in", F.lit(1))
    placed = docs.join(few(plan.select("__s", F.col("__nb")), ROW), "__s").withColumn("__b", block).drop("__nb")
    placed = placed.join(few(blocks.drop("__nb"), ROW), ["__s", "__b"]).join(few(chosen, 32), "__rk", "left")
    more = F.when(F.col("__left") == -1, 1).when(F.col("__left") > 0, F.coalesce("__in", F.lit(0))).otherwise(0)
    times = (F.col("__full") + more).cast("int")
    epochs = F.when(times >= 1, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>"))
    outer = {i: c for c, i in inner.items()}
    made = placed.select(*[F.col(i).alias(outer[i]) for i in names], F.col("n_tokens").alias(added[0]), F.explode(epochs).alias(added[1]))
    return sized(made, given)
