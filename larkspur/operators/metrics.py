"""Metrics of prediction frames as aggregates.

A frame has truth and prediction columns; ``by`` names grouping columns (fold,
learner, ...), or none. Ties are collapsed first (one row for each distinct
score), and running counts are made in two levels (ids.running), so that no
metric sorts a whole frame in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.errors import InputError
from larkspur.ids import running

CLIP = 1e-15
HIGHER_IS_BETTER = ("auc", "pr_auc", "cindex", "accuracy", "macro_f1")
APPLICABLE = {"binomial": ("auc", "pr_auc", "accuracy", "log_loss"), "multiclass": ("accuracy", "macro_f1", "log_loss"), "gaussian": ("rmse", "cindex"), "survival": ("cindex",)}


def _keys(df: DataFrame, by: list[str]) -> tuple[DataFrame, list[str]]:
    """A constant key where none is given."""
    return (df, by) if by else (df.withColumn("__all", F.lit(1)), ["__all"])


def _ties(df: DataFrame, truth: str, pred: str, by: list[str]) -> DataFrame:
    """by, pred, n1, n0: labels of each distinct score."""
    ok = df.where(F.col(truth).isNotNull() & F.col(pred).isNotNull() & ~F.isnan(F.col(pred).cast("double")))
    return ok.groupBy(*by, F.col(pred).cast("double").alias("pred")).agg(F.sum((F.col(truth) == 1).cast("long")).alias("n1"), F.sum((F.col(truth) == 0).cast("long")).alias("n0"))


def auc(df: DataFrame, truth: str = "truth", pred: str = "pred", by: list[str] = (), direction: str = "plain") -> DataFrame:
    """by, auc: P(positive > negative) + P(tie) / 2; null with one class.

    direction auto flips where the median of the negatives is the larger one.
    """
    keyed, by_ = _keys(df, list(by))
    ties = running(_ties(keyed, truth, pred, by_), by_, "pred", {"c0": "n0"})
    wins = F.sum(F.col("n1") * (F.col("c0") - F.col("n0") + F.col("n0") / 2))
    out = ties.groupBy(*by_).agg((wins / F.when((F.sum("n1") > 0) & (F.sum("n0") > 0), F.sum("n1").cast("double") * F.sum("n0"))).alias("auc"))
    if direction == "auto":
        y = F.col(truth)
        medians = keyed.groupBy(*by_).agg(F.median(F.when(y == 1, F.col(pred))).alias("m1"), F.median(F.when(y == 0, F.col(pred))).alias("m0"))
        out = out.join(medians, by_).withColumn("auc", F.when(F.col("m0") > F.col("m1"), 1 - F.col("auc")).otherwise(F.col("auc")))
    return out.select(*by, "auc")


def midranks(df: DataFrame, pred: str = "pred") -> DataFrame:
    """df with mid: the mean rank (from 1) of rows of its score; null where the score is null or NaN."""
    score = F.col(pred).cast("double")
    known = df.withColumn("__score", F.when(~F.isnan(score), score))
    ties = known.where("__score is not null").groupBy("__score").agg(F.count(F.lit(1)).alias("n"))
    upto = running(ties, [], "__score", {"c": "n"}).select("__score", (F.col("c") - (F.col("n") - 1) / 2).alias("mid"))
    return known.join(upto, "__score", "left").drop("__score")


def pr_auc(df: DataFrame, truth: str = "truth", pred: str = "pred", by: list[str] = ()) -> DataFrame:
    """by, pr_auc: area under precision over recall, interpolated between thresholds as counts grow (false positives linear in true ones)."""
    keyed, by_ = _keys(df, list(by))
    ties = _ties(keyed, truth, pred, by_).withColumn("neg", -F.col("pred"))
    c = running(ties, by_, "neg", {"tp": "n1", "fp": "n0"})
    # within a step from (tp0, fp0) with dt positives and df negatives: precision at tp0 + t is (tp0 + t) / (tp0 + t + fp0 + t df / dt)
    dt, dn = F.col("n1").cast("double"), F.col("n0").cast("double")
    tp0, fp0 = F.col("tp") - dt, F.col("fp") - dn
    slope, base = 1 + dn / dt, tp0 + fp0
    flat = F.when(base > 0, dt / slope + (tp0 - base / slope) / slope * F.log((base + slope * dt) / base)).otherwise(dt / slope)
    area = F.sum(F.when(dt > 0, flat))
    out = c.groupBy(*by_).agg((area / F.when((F.sum("n1") > 0) & (F.sum("n0") > 0), F.sum("n1"))).alias("pr_auc"))
    return out.select(*by, "pr_auc")


def accuracy(df: DataFrame, truth: str = "truth", pred: str = "pred", by: list[str] = (), threshold: float | None = 0.5) -> DataFrame:
    """by, accuracy. With threshold None, pred holds classes."""
    guess = F.col(pred) if threshold is None else (F.col(pred) >= threshold).cast("int")
    return df.where(F.col(truth).isNotNull() & F.col(pred).isNotNull()).groupBy(*by).agg(F.avg((guess == F.col(truth)).cast("double")).alias("accuracy"))


def confusion(df: DataFrame, truth: str, guess: Column, by: list[str]) -> DataFrame:
    t, g = F.col(truth), guess
    return df.where(t.isNotNull() & g.isNotNull()).groupBy(*by).agg(*[F.count_if((t == a) & (g == b)).cast("double").alias(n) for n, a, b in (("tp", 1, 1), ("fn", 1, 0), ("fp", 0, 1), ("tn", 0, 0))])


def threshold_metrics(df: DataFrame, thresholds: list[float], truth: str = "truth", pred: str = "pred", by: list[str] = ()) -> DataFrame:
    """by, threshold, accuracy, balanced_accuracy, f1, for all thresholds in one pass."""
    long = df.select(*by, truth, pred, F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold"))
    c = confusion(long, truth, (F.col(pred) >= F.col("threshold")).cast("int"), [*by, "threshold"])
    recall, spec = F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0.0)), F.col("tn") / F.nullif(F.col("tn") + F.col("fp"), F.lit(0.0))
    n, f1 = F.expr("tp + fn + fp + tn"), 2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0.0))
    return c.select(*by, "threshold", ((F.col("tp") + F.col("tn")) / n).alias("accuracy"), ((recall + spec) / 2).alias("balanced_accuracy"), F.coalesce(f1, F.lit(0.0)).alias("f1"))


def macro_f1(df: DataFrame, truth: str = "truth", guess: str = "pred_class", by: list[str] = ()) -> DataFrame:
    """by, macro_f1: mean F1 over the classes of truth; an undefined one is 0, unless all are."""
    keyed, by_ = _keys(df, list(by))
    ok = keyed.where(F.col(truth).isNotNull() & F.col(guess).isNotNull())
    pairs = ok.groupBy(*by_, F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    sides = F.explode(F.array(F.struct(F.col("t").alias("c"), F.col("n").alias("nt"), F.lit(0).cast("long").alias("ng"), F.when(F.col("t") == F.col("g"), F.col("n")).otherwise(0).alias("tp")), F.struct(F.col("g").alias("c"), F.lit(0).cast("long").alias("nt"), F.col("n").alias("ng"), F.lit(0).cast("long").alias("tp"))))
    each = pairs.select(*by_, sides.alias("s")).groupBy(*by_, "s.c").agg(F.sum("s.nt").alias("nt"), F.sum("s.ng").alias("ng"), F.sum("s.tp").alias("tp")).where("nt > 0")
    f1 = F.when(F.col("tp") > 0, 2 * F.col("tp") / (F.col("nt") + F.col("ng")))
    return each.groupBy(*by_).agg(F.when(F.count(f1) > 0, F.avg(F.coalesce(f1, F.lit(0.0)))).alias("macro_f1")).select(*by, "macro_f1")


def log_loss(df: DataFrame, truth: str = "truth", pred: str = "pred", by: list[str] = ()) -> DataFrame:
    p = F.least(F.greatest(F.col(pred), F.lit(CLIP)), F.lit(1 - CLIP))
    return df.where(F.col(truth).isNotNull() & F.col(pred).isNotNull()).groupBy(*by).agg((-F.avg(F.when(F.col(truth) == 1, F.log(p)).otherwise(F.log(1 - p)))).alias("log_loss"))


def multiclass_log_loss(df: DataFrame, levels: list[str], truth: str = "truth", probabilities: str = "probabilities", by: list[str] = ()) -> DataFrame:
    """probabilities: an array in the order of levels."""
    p = F.element_at(probabilities, F.array_position(F.array(*[F.lit(x) for x in levels]), F.col(truth)).cast("int"))
    clipped = F.least(F.greatest(p, F.lit(CLIP)), F.lit(1 - CLIP))
    return df.where(F.col(truth).isin(*levels)).groupBy(*by).agg((-F.avg(F.log(clipped))).alias("log_loss"))


def rmse(df: DataFrame, truth: str = "truth", pred: str = "pred", by: list[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.sqrt(F.avg(F.pow(F.col(truth) - F.col(pred), 2))).alias("rmse"))


def brier(df: DataFrame, truth: str = "truth", pred: str = "pred", by: list[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.pow(F.col(truth) - F.col(pred), 2)).alias("brier"))


CINDEX_GRID = 64


def cindex(df: DataFrame, truth: str = "truth", pred: str = "pred", by: list[str] = (), event: str | None = None, risk: bool = False) -> DataFrame:
    """by, cindex: of pairs with unlike truth, the share that predictions order alike, ties a half; null without such pairs.

    With event (1: observed), truth is a time, and a pair counts if the earlier
    time is an event. A larger prediction means a longer time, unless risk.
    Counted by sorting: for each bit of the rank of truth, rows with it set meet
    those without it in order of the prediction, so whole groups of pairs are
    never formed. Frames without ``by`` are cut into CINDEX_GRID ranges of
    truth: pairs across ranges come from a smaller histogram join of range
    pairs.
    """
    import numpy as np
    import pyarrow as pa

    keyed, by_ = _keys(df, list(by))
    sign = -1.0 if risk else 1.0
    ok = keyed.select(*by_, F.col(truth).cast("double").alias("t"), (F.col(pred).cast("double") * sign).alias("p"), (F.col(event).cast("int") if event else F.lit(1)).alias("e"))
    ok = ok.where("t is not null and p is not null and e is not null and not isnan(t) and not isnan(p)")
    ties = ok.groupBy(*by_, "t", "p", "e").agg(F.count(F.lit(1)).alias("n"))

    def count(table: pa.Table) -> pa.Table:
        t, p, e, n = (table.column(c).to_numpy() for c in ("t", "p", "e", "n"))
        order = np.argsort(p, kind="stable")
        t, p, e, n = t[order], p[order], e[order], n[order].astype(np.float64)
        times, t = np.unique(t, return_inverse=True)
        events = np.where(e == 1, n, 0.0)
        earlier = np.concatenate(([0.0], np.cumsum(np.bincount(t, events, minlength=len(times)))[:-1]))
        good = 0.0
        for bit in range(max(1, int(len(times) - 1).bit_length())):
            # two times first differ in one bit: rows with it set meet events without it, within the same higher bits
            part = t >> (bit + 1)
            by = np.argsort(part, kind="stable")  # within a part in order of p
            late = (t[by] >> bit & 1).astype(bool)
            sums = np.concatenate(([0.0], np.cumsum(np.where(late, 0.0, events[by]))))
            new_part = np.concatenate(([True], part[by][1:] != part[by][:-1]))
            new = new_part | np.concatenate(([True], p[by][1:] != p[by][:-1]))
            first = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            start = np.flatnonzero(new_part)[np.cumsum(new_part) - 1]
            below = sums[first[group]] - sums[start]
            tied = sums[np.append(first[1:], len(by))[group]] - sums[first[group]]
            good += float((n[by] * (below + 0.5 * tied))[late].sum())
        return pa.table({**{c: table.column(c)[:1] for c in by_}, "good": [good], "pairs": [float((n * earlier[t]).sum())]})

    from pyspark.sql import types as T

    schema = T.StructType([ties.schema[c] for c in by_] + [T.StructField("good", T.DoubleType()), T.StructField("pairs", T.DoubleType())])
    if by:
        counted = ties.groupBy(*by_).applyInArrow(count, schema)
    else:
        counted = _cindex_cells(ties, count, schema)
    return counted.select(*by, (F.col("good") / F.nullif(F.col("pairs"), F.lit(0.0))).alias("cindex"))


def _cindex_cells(ties: DataFrame, count, schema) -> DataFrame:
    """Pairs within a range of truth are counted in it; pairs across ranges by prediction ranges, and those in one by the tree again."""
    cuts = ties.stat.approxQuantile("t", [i / CINDEX_GRID for i in range(1, CINDEX_GRID)], 0.001) if ties.limit(1).count() else []
    cell = sum([(F.col("t") > c).cast("int") for c in sorted(set(cuts))], F.lit(0))
    celled = ties.withColumn("cell", cell)
    inside = celled.groupBy("cell").applyInArrow(lambda table: count(table.drop(["cell"])), schema)
    # across cells: for each prediction, events of earlier cells that lie below it or tie with it
    events = celled.where("e = 1").groupBy("cell", "p").agg(F.sum("n").alias("ne"))
    targets = celled.groupBy("cell", "p").agg(F.sum("n").alias("nt"))
    later = targets.select(F.col("p"), F.col("cell"), F.col("nt"), F.lit(0).cast("long").alias("ne"), F.lit(1).alias("kind"))
    copies = events.select("p", F.explode(F.sequence(F.col("cell") + 1, F.lit(CINDEX_GRID))).alias("cell"), F.lit(0).cast("long").alias("nt"), "ne", F.lit(0).alias("kind"))
    merged = later.unionAll(copies).groupBy("cell", "p").agg(F.sum("nt").alias("nt"), F.sum("ne").alias("ne"))
    ran = running(merged, ["cell"], "p", {"c": "ne"})
    total = merged.groupBy("cell").agg(F.sum("ne").alias("all"))
    across = ran.join(F.broadcast(total), "cell").agg(F.sum(F.col("nt") * (F.col("c") - F.col("ne") + F.col("ne") / 2)).alias("good"), F.sum(F.col("nt") * F.col("all")).cast("double").alias("pairs"))
    return inside.select("good", "pairs").unionAll(across).agg(F.sum("good").alias("good"), F.sum("pairs").alias("pairs"))


def evaluate(df: DataFrame, metric: str, task: str, truth: str = "truth", pred: str = "pred", by: list[str] = (), levels: list[str] | None = None, guess: str = "pred_class", probabilities: str = "probabilities", event: str = "event", **more) -> DataFrame:
    """by and a column named metric; metrics that don't suit the task are an error.

    Multiclass frames hold a class in guess and, for log_loss, probabilities in
    the order of levels; survival frames hold event, and pred is a risk.
    """
    if metric not in APPLICABLE[task]:
        raise InputError(f"{metric} doesn't apply to {task} outcomes")
    if task == "multiclass":
        if metric == "log_loss":
            if levels is None:
                raise InputError("log_loss of several classes needs their levels")
            return multiclass_log_loss(df, levels, truth, probabilities, by)
        own = guess if guess in df.columns else pred
        return accuracy(df, truth, own, by, None) if metric == "accuracy" else macro_f1(df, truth, own, by)
    if task == "survival":
        return cindex(df, truth, pred, by, event, more.pop("risk", True), **more)
    return {"auc": auc, "pr_auc": pr_auc, "accuracy": accuracy, "log_loss": log_loss, "rmse": rmse, "cindex": cindex}[metric](df, truth, pred, by, **more)


def placements(df: DataFrame, truth: str = "truth", pred: str = "pred", by: list[str] = ("fold",)) -> DataFrame:
    """by, pred, n1, n0, v10, v01: the share of negatives below each positive's score (ties a half), and of positives above each negative's."""
    ties = running(_ties(df, truth, pred, list(by)), list(by), "pred", {"c0": "n0", "c1": "n1"})
    total = ties.groupBy(*by).agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"))
    v10 = (F.col("c0") - F.col("n0") / 2) / F.col("t0")
    v01 = (F.col("t1") - F.col("c1") + F.col("n1") / 2) / F.col("t1")
    return ties.join(total, list(by)).where("t0 > 0 and t1 > 0").select(*by, "pred", "n1", "n0", v10.alias("v10"), v01.alias("v01"))


def cvauc_if(df: DataFrame, truth: str = "truth", pred: str = "pred", by: list[str] = ("fold",)) -> DataFrame:
    """by, auc, var_if, n1, n0: each fold's AUC and its variance, var(V10) / n1 + var(V01) / n0 with sample variances."""
    p = placements(df, truth, pred, by)

    def variance(v: str, n: str) -> Column:
        k, mean = F.sum(n), F.sum(F.col(v) * F.col(n)) / F.sum(n)
        return F.when(k > 1, (F.sum(F.col(v) * F.col(v) * F.col(n)) - k * mean * mean) / (k - 1)).otherwise(0.0)

    return p.groupBy(*by).agg((F.sum(F.col("v10") * F.col("n1")) / F.sum("n1")).alias("auc"), (F.greatest(variance("v10", "n1"), F.lit(0.0)) / F.sum("n1") + F.greatest(variance("v01", "n0"), F.lit(0.0)) / F.sum("n0")).alias("var_if"), F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def pooled_cvauc(folds: DataFrame, weight: str | None = None) -> DataFrame:
    """mean_auc, var_auc, n_folds: weighted mean of fold AUCs and its variance, weights summing to 1 (equal if none are given)."""
    w = F.col(weight) if weight else F.lit(1.0)
    return folds.agg((F.sum(w * F.col("auc")) / F.sum(w)).alias("mean_auc"), (F.sum(w * w * F.col("var_if")) / F.pow(F.sum(w), 2)).alias("var_auc"), F.count(F.lit(1)).alias("n_folds"))
