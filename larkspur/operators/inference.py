"""Inflation of a leaky pipeline's score over a guarded one's: paired repeats, robust location, resampling tests.

Folds are reduced to repeats in Spark; what follows works on at most a few
hundred numbers, on the driver.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators import metrics as M
from larkspur.errors import FallbackWarning, warn
from larkspur.functions.stats_dist import norm_cdf, norm_ppf

EXACT = 15  # up to so many signs, all combinations are enumerated
LOWER_IS_BETTER = re.compile(r"rmse|mae|mse|loss|error|brier", re.IGNORECASE)


def higher_is_better(metric: str) -> bool:
    """By the metric's name: loss and error anywhere in it mean lower."""
    return not LOWER_IS_BETTER.search(metric)


def fold_metrics(predictions: DataFrame, metric: str = "auc", task: str = "binomial", learner: str | None = None) -> DataFrame:
    """(repeat_id, fold, value, n): a fit's metric by fold, recomputed from its predictions."""
    own = predictions.where(F.col("learner") == learner) if learner else predictions
    by = ["repeat_id", "fold"]
    return M.evaluate(own, metric, task, "truth", "pred", by).withColumnRenamed(metric, "value").join(own.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), by)


def repeat_means(folds: DataFrame, value: str = "value", size: str = "n") -> DataFrame:
    """(repeat_id, mean, folds): means over finite folds, weighted by test size (1 at least)."""
    ok = folds.where(F.col(value).isNotNull() & ~F.isnan(value))
    w = F.greatest(F.coalesce(F.col(size), F.lit(1)), F.lit(1)).cast("double")
    return ok.groupBy("repeat_id").agg((F.sum(w * F.col(value)) / F.sum(w)).alias("mean"), F.count(F.lit(1)).alias("folds"))


def deltas(leaky: DataFrame, guarded: DataFrame, metric: str = "auc", value: str = "value", size: str = "n") -> DataFrame:
    """(repeat_id, leaky, guarded, delta): positive where the leaky pipeline looks better."""
    a = repeat_means(leaky, value, size).select("repeat_id", F.col("mean").alias("leaky"))
    b = repeat_means(guarded, value, size).select("repeat_id", F.col("mean").alias("guarded"))
    sign = 1.0 if higher_is_better(metric) else -1.0
    return a.join(b, "repeat_id").withColumn("delta", (F.col("leaky") - F.col("guarded")) * sign)


def pairing(a: DataFrame, b: DataFrame, id_col: str) -> DataFrame:
    """(repeat_id, fold, same): both plans have the same test rows at that place. a, b: id, repeat_id, fold.

    Row digests are summed by words, so sets of any size compare without being collected.
    """
    def digest(df: DataFrame, name: str) -> DataFrame:
        h = F.md5(F.col(id_col).cast("string"))
        word = lambda at: F.sum(F.conv(F.substring("h", at, 8), 16, 10).cast("long"))
        return df.withColumn("h", h).groupBy("repeat_id", "fold").agg(F.concat_ws("|", F.count(F.lit(1)), word(1), word(9), word(17)).alias(name))

    both = digest(a, "x").join(digest(b, "y"), ["repeat_id", "fold"], "full")
    return both.select("repeat_id", "fold", F.coalesce(F.col("x") == F.col("y"), F.lit(False)).alias("same"))


def signflip_table(repeats: DataFrame, delta: str = "delta", order: str = "repeat_id", block_size: int = 1) -> DataFrame:
    """(p_value, n_blocks): the exact sign-flip test of up to EXACT blocks, as a DataFrame over all sign patterns."""
    block = F.expr(f"(row_number() over (order by {order}) - 1) div {block_size}")  # of at most a few repeats
    blocks = repeats.select(block.cast("int").alias("k"), F.col(delta).alias("d")).groupBy("k").agg(F.sum("d").alias("s"), F.count(F.lit(1)).alias("m"))
    whole = blocks.agg(F.collect_list(F.struct("k", "s")).alias("blocks"), F.sum("s").alias("total"), F.count(F.lit(1)).alias("n_blocks"), F.sum("m").alias("r"))
    patterns = whole.withColumn("j", F.explode(F.sequence(F.lit(0), (F.pow(F.lit(2.0), F.col("n_blocks")) - 1).cast("int"))))
    flipped = F.aggregate("blocks", F.lit(0.0), lambda acc, x: acc + x["s"] * (F.lit(1.0) - F.lit(2.0) * F.call_function("getbit", F.col("j").cast("long"), x["k"]).cast("double")))
    hit = F.abs(flipped / F.col("r")) >= F.abs(F.col("total") / F.col("r")) - 2.220446049250313e-14
    return patterns.groupBy("n_blocks").agg(F.avg(hit.cast("double")).alias("p_value"))


def sign_flip(delta: list[float], flips: int = 10_000, seed: int = 42, block_size: int = 1) -> dict:
    """p_value, n_blocks of the sign-flip test of the mean; blocks of repeats flip together. Many blocks are drawn at random, with one added to both counts."""
    d = np.array([x for x in delta if x is not None and math.isfinite(x)])
    blocks = np.arange(len(d)) // max(1, block_size)
    n = int(blocks[-1]) + 1 if len(d) else 0
    if len(d) < 2:
        return {"p_value": None, "n_blocks": n}
    if n < 2:
        return {"p_value": 1.0, "n_blocks": n}
    sums, goal = np.bincount(blocks, d), abs(d.mean()) - 2.220446049250313e-14
    if n <= EXACT:
        signs = 1 - 2 * (np.arange(2**n)[:, None] >> np.arange(n) & 1)
        return {"p_value": float((np.abs(signs @ sums / len(d)) >= goal).mean()), "n_blocks": n}
    signs = np.random.default_rng(seed).integers(0, 2, (flips, n)) * 2 - 1
    return {"p_value": float(((np.abs(signs @ sums / len(d)) >= goal).sum() + 1) / (flips + 1)), "n_blocks": n}


def ar1_block_size(repeats: DataFrame, delta: str = "delta", order: str = "repeat_id") -> DataFrame:
    """(rho, block_size): about 1 / (1 - lag-one correlation), at most a third of the repeats; 1 for fewer than four."""
    w = Window.orderBy(order)  # of the repeats
    r = repeats.select(F.col(delta).alias("d"), F.lag(delta).over(w).alias("p")).agg(F.corr("d", "p").alias("rho"), F.count("d").alias("n"))
    rho = F.greatest(F.coalesce(F.nanvl("rho", F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
    size = F.when(rho >= 0.99, F.col("n")).otherwise(F.ceil(1 / (1 - rho)))
    capped = F.least(size, F.greatest(F.floor(F.col("n") / 3), F.lit(1)))
    return r.select(rho.alias("rho"), F.when(F.col("n") < 4, 1).otherwise(F.greatest(capped, F.lit(1))).cast("long").alias("block_size"))


def huber(values: list[float], k: float = 1.345, tol: float = 1e-8, rounds: int = 100) -> float:
    """Huber's location with the scale fixed at 1.4826 MAD; the median where that is 0."""
    x = np.array([v for v in values if v is not None and math.isfinite(v)])
    if len(x) < 2:
        return float(x[0]) if len(x) else math.nan
    mu = float(np.median(x))
    scale = 1.4826 * float(np.median(np.abs(x - mu)))
    if scale < tol:
        return mu
    for _ in range(rounds):
        r = np.abs(x - mu) / scale
        w = np.where(r <= k, 1.0, k / np.maximum(r, 1e-300))
        new = float((w * x).sum() / w.sum())
        if abs(new - mu) < tol * (1 + abs(mu)):
            break
        mu = new
    return mu


def bca_interval(values: list[float], stat=huber, draws: int = 2000, level: float = 0.95, seed: int = 42) -> tuple[float, float]:
    """Bias-corrected and accelerated bootstrap interval."""
    x = np.array([v for v in values if v is not None and math.isfinite(v)])
    if len(x) < 2:
        return math.nan, math.nan
    rng = np.random.default_rng(seed)
    boot = np.array([stat(x[i]) for i in rng.integers(0, len(x), (draws, len(x)))])
    boot = boot[np.isfinite(boot)]
    if len(boot) < 10:
        return math.nan, math.nan
    m = len(boot)
    z0 = norm_ppf(min(1 - 1 / m, max(1 / m, float((boot < stat(x)).mean()))))
    jack = np.array([stat(np.delete(x, i)) for i in range(len(x))])
    d = jack.mean() - jack
    denominator = 6 * float((d**2).sum()) ** 1.5
    a = float((d**3).sum()) / denominator if denominator > 1e-12 else 0.0
    alpha = 1 - level

    def at(z: float) -> float:
        q = 1 - a * (z0 + z)
        return alpha / 2 if abs(q) < 1e-10 else norm_cdf(z0 + (z0 + z) / q)

    p = [min(1 - 1 / m, max(1 / m, at(norm_ppf(q)))) for q in (alpha / 2, 1 - alpha / 2)]
    lo, hi = np.quantile(boot, p)
    return float(lo), float(hi)


def tier(repeats: int) -> str:
    return "A" if repeats >= 20 else "B" if repeats >= 10 else "C" if repeats >= 5 else "D"


@dataclass
class InflationResult:
    metric: str
    repeats: list[dict]
    robust: float
    mean: float
    ci: tuple[float, float]
    p_value: float | None
    n_blocks: int
    tier: str
    paired: bool
    inference_ok: bool
    info: dict = field(default_factory=dict)

    @property
    def r_eff(self) -> int:
        return len(self.repeats)

    def describe(self) -> str:
        p = "none" if self.p_value is None else f"{self.p_value:.4g}"
        return f"inflation of {self.metric}: {self.robust:.4g} [{self.ci[0]:.4g}, {self.ci[1]:.4g}], p {p}, {self.r_eff} repeats, tier {self.tier}"


def delta_lsi(leaky: DataFrame, guarded: DataFrame, metric: str = "auc", exchangeability: str = "iid", block_size: int | None = None, draws: int = 2000, flips: int = 10_000, plans: tuple[DataFrame, DataFrame, str] | None = None, seed: int = 42) -> InflationResult:
    """leaky, guarded: repeat_id, fold, value, n (test size). plans: both assignments and their id column, to check the pairing."""
    paired = plans is None or not pairing(*plans).where("not same").limit(1).count()
    table = deltas(leaky, guarded, metric)
    rows = [r.asDict() for r in table.orderBy("repeat_id").collect()] if paired else []
    if not paired:
        warn("the pipelines' splits differ: repeats are matched by number only", FallbackWarning)
        rows = [r.asDict() for r in table.orderBy("repeat_id").collect()]
    d = [r["delta"] for r in rows]
    grade, r = tier(len(d)), len(d)
    ci = bca_interval(d, draws=draws, seed=seed) if paired and r >= 10 else (math.nan, math.nan)
    test = {"p_value": None, "n_blocks": 0}
    if paired and r >= 5:
        if exchangeability in ("by_group", "within_batch"):
            warn(f"{exchangeability} isn't told apart from iid", FallbackWarning)
        size = 1
        if exchangeability == "blocked_time":
            size = block_size or ar1_block_size(table).first()["block_size"]
        test = sign_flip(d, flips, seed, size)
        if exchangeability == "blocked_time" and test["n_blocks"] < 5:
            warn("under five blocks: no p-value", FallbackWarning)
            test["p_value"] = None
    return InflationResult(metric, rows, huber(d), float(np.mean(d)) if d else math.nan, ci, test["p_value"], test["n_blocks"], grade, paired, paired and grade == "A", {"exchangeability": exchangeability})
