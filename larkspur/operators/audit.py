"""Leakage audits: permutation gap, fold-by-batch association, target scans, near duplicates, and what they say together."""

from __future__ import annotations

import hashlib
import itertools
import json
import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.errors import AuditError, InputError
from larkspur.functions import stats_dist as D
from larkspur.functions.columns import Stored, stored
from larkspur.ids import running
from larkspur.operators import metrics as M
from larkspur.operators import permute as P
from larkspur.operators import uncertainty as U
from larkspur.operators.guard import long_form
from larkspur.operators.splits import SplitPlan

TASK_ROWS = 20_000_000  # whose columns a task of permutations holds at most: about 35 bytes of each
FIT_ROWS = 65_536  # that a linear fit makes copies of
BATCH_COLUMNS = ("batch", "plate", "center", "site", "study")
#: Fixed values that results hold: mechanism, the audit's part, its statistics.
TAXONOMY = (
    ("non_random_signal", "permutation_gap", "gap,p_value"),
    ("confounding_alignment", "batch_assoc", "pval,cramer_v"),
    ("proxy_target_leakage", "target_assoc", "score,p_value,p_value_adj"),
    ("duplicate_overlap", "duplicates", "similarity,cross_fold"),
    ("temporal_lookahead", "duplicates", "cross_fold,time-aware split"),
)


# -- permutation gap


def permutation_values(df: DataFrame, id_col: str, metric: str, task: str, n: int, truth: str = "truth", pred: str = "pred", seed: int = 1, labels: DataFrame | None = None) -> DataFrame:
    """(b, value): the pooled metric under each permutation of the truth; predictions stay. labels: (b, id, truth) of another scheme than the global one."""
    if labels is None and metric == "auc" and not df.where(F.col(truth).isNull()).limit(1).count():
        return _shuffled_auc(df, id_col, n, truth, pred, seed)
    labels = P.shuffled(df, id_col, truth, n, seed) if labels is None else labels
    scored = labels.join(df.select(id_col, pred), id_col)
    return M.evaluate(scored, metric, task, truth, pred, ["b"]).withColumnRenamed(metric, "value")


def _shuffled_auc(df: DataFrame, id_col: str, n: int, truth: str, pred: str, seed: int) -> DataFrame:
    """(b, value): AUCs of global shuffles. Scores are ranked once; a permutation is a sum of the ranks that its positives come to.

    Up to TASK_ROWS rows a permutation is an order of hashes in a task that
    holds the columns; beyond, all permutations are rows of one shuffle.
    """
    score = F.col(pred).cast("double")
    slim = df.select(P.place_order(df, id_col).alias("at"), F.col(id_col).alias("id"), F.col(id_col).cast("string").alias("text"), F.col(truth).cast("double").alias("y"), F.when(~F.isnan(score), score).alias("score"))
    with stored(slim, "at", "id") as held:
        if held.rows <= TASK_ROWS:
            return _auc_tasks(df.sparkSession, held, n, seed)
    ranked = P.places(M.midranks(df, pred), id_col, [], "mid").where("mid is not null").select("i", "mid")
    y = F.col(truth)
    sums = P.draws(df, id_col, truth, n, seed).join(ranked, "i").groupBy("b").agg(F.sum(F.when(y == 1, F.col("mid"))).alias("r"), F.count_if(y == 1).cast("double").alias("n1"), F.count_if(y == 0).cast("double").alias("n0"))
    return sums.select("b", F.when((F.col("n1") > 0) & (F.col("n0") > 0), (F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2) / (F.col("n1") * F.col("n0"))).alias("value"))


def _auc_tasks(spark, held: Stored, n: int, seed: int) -> DataFrame:
    import pandas as pd

    def values(batches):
        texts, code, mid = P.texts_of(held), held.column("y"), midranks(held.column("score"))
        code = np.where(code == 1, 1, np.where(code == 0, 0, 2)).astype(np.int8)
        known = ~np.isnan(mid)
        mid[~known] = 0.0
        for pdf in batches:
            out = []
            for b in pdf["b"]:
                drawn = texts.drawn(P.draw_prefix(seed, int(b)), code)
                ones = drawn == 1
                n1, n0 = int((ones & known).sum()), int(((drawn == 0) & known).sum())
                out.append((mid[ones].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) if n1 and n0 else None)
            yield pd.DataFrame({"b": pdf["b"].astype("int32"), "value": pd.Series(out, dtype="float64")})

    found = P.numbered(spark, 1, n).mapInPandas(values, "b int, value double").collect()  # a number for each permutation
    return spark.createDataFrame([tuple(r) for r in found], "b int, value double")


def observed(df: DataFrame, metric: str, task: str, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """(value): the metric pooled over all folds and repeats."""
    return M.evaluate(df, metric, task, truth, pred).withColumnRenamed(metric, "value")


def gap_table(df: DataFrame, id_col: str, metric: str, task: str, n: int, truth: str = "truth", pred: str = "pred", seed: int = 1, labels: DataFrame | None = None) -> DataFrame:
    """metric_obs, perm_mean, perm_sd, gap, p_value, n_perm, as one row; the gap is positive where the score is better than permuted ones."""
    higher = metric in M.HIGHER_IS_BETTER
    obs = observed(df, metric, task, truth, pred).withColumnRenamed("value", "metric_obs")
    values = permutation_values(df, id_col, metric, task, n, truth, pred, seed, labels)
    joined = values.join(F.broadcast(obs))  # one row: no product
    hit = (F.col("value") >= F.col("metric_obs")) if higher else (F.col("value") <= F.col("metric_obs"))
    agg = joined.agg(F.max("metric_obs").alias("metric_obs"), F.avg("value").alias("perm_mean"), F.stddev_samp("value").alias("perm_sd"), F.count_if(hit).alias("hits"), F.count("value").alias("n_perm"))
    gap = F.col("metric_obs") - F.col("perm_mean") if higher else F.col("perm_mean") - F.col("metric_obs")
    return agg.select("metric_obs", "perm_mean", "perm_sd", gap.alias("gap"), ((F.col("hits") + 1) / (F.col("n_perm") + 1)).alias("p_value"), "n_perm")


# -- association tables


def chisq_assoc(df: DataFrame, a: str, b: str, by: list[str] = ()) -> DataFrame:
    """by, stat, df, cramer_v, n of the table a x b; 2 x 2 tables get Yates' correction; null with fewer than two levels.

    From the cells that occur: the sum of O^2 / E, less n.
    """
    by = list(by)
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, a, b).agg(F.count(F.lit(1)).alias("o"))
    rows, cols = cells.groupBy(*by, a).agg(F.sum("o").alias("r")), cells.groupBy(*by, b).agg(F.sum("o").alias("c"))
    # of each side: levels, and the sum of 1 / total, which gives that of 1 / E over all cells, empty ones too
    ra = rows.groupBy(*by).agg(F.sum("r").alias("n"), F.count(F.lit(1)).alias("ka"), F.sum(1 / F.col("r").cast("double")).alias("ia"))
    cb = cols.groupBy(*by).agg(F.count(F.lit(1)).alias("kb"), F.sum(1 / F.col("c").cast("double")).alias("ib"))
    size = ra.join(cb, by) if by else ra.join(F.broadcast(cb))  # one row each
    full = cells.join(rows, [*by, a]).join(cols, [*by, b])
    full = full.join(size, by) if by else full.join(F.broadcast(size))
    e = F.col("r").cast("double") * F.col("c") / F.col("n")
    g = full.groupBy(*by).agg(F.sum(F.col("o") * F.col("o") / e).alias("q"), F.max(F.abs(F.col("o") - e)).alias("dev"), *[F.max(k).alias(k) for k in ("n", "ka", "kb", "ia", "ib")])
    g = g.withColumn("two", (F.col("ka") == 2) & (F.col("kb") == 2))
    # Yates needs |O - E| of one cell only: in a 2 x 2 table it is the same in all four
    yates = F.pow(F.col("dev") - F.least(F.lit(0.5), F.col("dev")), 2) * F.col("ia") * F.col("ib") * F.col("n")
    stat = F.when((F.col("ka") < 2) | (F.col("kb") < 2), None).when(F.col("two"), yates).otherwise(F.col("q") - F.col("n"))
    v = F.sqrt(F.greatest(F.col("stat"), F.lit(0.0)) / (F.col("n") * (F.least("ka", "kb") - 1)))
    made = g.withColumn("stat", stat)
    return made.select(*by, "stat", ((F.col("ka") - 1) * (F.col("kb") - 1)).cast("long").alias("df"), F.when(F.col("stat").isNotNull(), v).alias("cramer_v"), "n")


def batch_assoc(plan: SplitPlan, samples: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(batch_col, repeat_id, stat, df, cramer_v): test folds against each batch column, for each repeat, in one pass."""
    columns = columns or [c for c in BATCH_COLUMNS if c in samples.columns]
    if not columns:
        raise AuditError("no batch columns")
    rows = plan.assign.join(samples.select(plan.id_col, *columns), plan.id_col)
    long = rows.select("repeat_id", "fold", F.explode(F.array(*[F.struct(F.lit(c).alias("batch_col"), F.col(c).cast("string").alias("level")) for c in columns])).alias("s")).select("repeat_id", "fold", "s.*")
    return chisq_assoc(long, "fold", "level", ["batch_col", "repeat_id"]).drop("n")


def with_pvalues(table: DataFrame, alpha_from: str = "chi2") -> list[dict]:
    """Rows of a small result table with pval, by its stat and df."""
    return [r.asDict() | {"pval": None if r["stat"] is None else D.chi2_sf(max(r["stat"], 0.0), r["df"])} for r in table.collect()]


# -- target scan


def scan_numeric_binary(df: DataFrame, columns: list[str], y: str) -> DataFrame:
    """feature, metric, value, score, z, n: AUC of each column, |AUC - 1/2| * 2, and the rank-sum test's z with ties and continuity corrected."""
    long = _finite_long(df, columns, y).where(F.col(y).isNotNull())
    ties = long.groupBy("feature", "x").agg(F.sum((F.col(y) == 1).cast("long")).alias("n1"), F.sum((F.col(y) == 0).cast("long")).alias("n0"))
    ranked = running(ties, ["feature"], "x", {"c0": "n0"})
    t = (F.col("n1") + F.col("n0")).cast("double")
    g = ranked.groupBy("feature").agg(F.sum(F.col("n1") * (F.col("c0") - F.col("n0") + F.col("n0") / 2)).alias("u"), F.sum("n1").cast("double").alias("a"), F.sum("n0").cast("double").alias("b"), F.sum(t * t * t - t).alias("ties"), F.count(F.lit(1)).alias("k"))
    g = g.where("a > 0 and b > 0 and k > 1 and a + b >= 3")
    n = F.col("a") + F.col("b")
    auc, off = F.col("u") / (F.col("a") * F.col("b")), F.col("u") - F.col("a") * F.col("b") / 2
    sigma = F.sqrt(F.col("a") * F.col("b") / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    return g.select("feature", F.lit("auc").alias("metric"), auc.alias("value"), (F.abs(auc - 0.5) * 2).alias("score"), ((off - F.signum(off) * 0.5) / sigma).alias("z"), n.cast("long").alias("n"))


def scan_numeric_numeric(df: DataFrame, columns: list[str], y: str) -> DataFrame:
    """feature, metric, value, score, t, n: Pearson's r and its t."""
    long = _finite_long(df, columns, y).where(F.col(y).isNotNull())
    g = long.groupBy("feature").agg(F.corr("x", y).alias("value"), F.count(F.lit(1)).alias("n"), F.stddev_samp("x").alias("sx"), F.stddev_samp(y).alias("sy")).where("n >= 3 and sx > 0 and sy > 0")
    r = F.col("value")
    return g.select("feature", F.lit("cor").alias("metric"), "value", F.abs(r).alias("score"), (r * F.sqrt((F.col("n") - 2) / (1 - r * r))).alias("t"), "n")


def _eta(long: DataFrame, value: str, level: str) -> DataFrame:
    """feature, metric, value, score, f, d1, d2, n: share of the variance of value between levels."""
    g = long.groupBy("feature", level).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    mean = F.sum(F.col("n") * F.col("m")) / F.sum("n")
    s = g.groupBy("feature").agg(F.sum(F.col("n") * F.col("v")).alias("within"), (F.sum(F.col("n") * F.col("m") * F.col("m")) - F.sum("n") * mean * mean).alias("between"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    s = s.where("k >= 2 and n >= 3 and within + between > 0")
    eta, d1, d2 = F.col("between") / (F.col("within") + F.col("between")), F.col("k") - 1, F.col("n") - F.col("k")
    return s.select("feature", F.lit("eta_sq").alias("metric"), eta.alias("value"), eta.alias("score"), (F.col("between") / d1 / (F.col("within") / d2)).alias("f"), d1.alias("d1"), d2.alias("d2"), "n")


def scan_numeric_classes(df: DataFrame, columns: list[str], y: str) -> DataFrame:
    long = _finite_long(df, columns, y).where(F.col(y).isNotNull())
    return _eta(long, "x", y)


def scan_categorical_numeric(df: DataFrame, columns: list[str], y: str) -> DataFrame:
    return _eta(_text_long(df, columns, y).where(F.col(y).isNotNull()), y, "level")


def scan_categorical_classes(df: DataFrame, columns: list[str], y: str) -> DataFrame:
    """feature, metric, value, score, stat, df, n: Cramer's V of each column with the classes."""
    t = chisq_assoc(_text_long(df, columns, y), "level", y, ["feature"]).where("stat is not null")
    return t.select("feature", F.lit("cramer_v").alias("metric"), F.col("cramer_v").alias("value"), F.col("cramer_v").alias("score"), "stat", "df", "n")


def _finite_long(df: DataFrame, columns: list[str], *keep: str) -> DataFrame:
    return long_form(df, columns, *keep).where(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") != float("inf")))


def _text_long(df: DataFrame, columns: list[str], *keep: str) -> DataFrame:
    return df.select(*keep, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("level")) for c in columns])).alias("f")).select(*keep, "f.*").where("level is not null")


def target_scan(df: DataFrame, y: str, task: str, numeric: list[str], categorical: list[str] = (), threshold: float = 0.9, adjust: str = "BH", alpha: float = 0.05) -> list[dict]:
    """One dict for each feature, by falling score: metric, value, score, p_value, p_value_adj, flag, flag_fdr, n."""
    if task not in ("binomial", "multiclass", "gaussian"):
        raise AuditError("target scans need classes or numbers as outcomes")
    rows = []
    if numeric:
        f = {"binomial": scan_numeric_binary, "multiclass": scan_numeric_classes, "gaussian": scan_numeric_numeric}[task]
        rows += f(df, list(numeric), y).collect()
    if categorical:
        rows += (scan_categorical_numeric if task == "gaussian" else scan_categorical_classes)(df, list(categorical), y).collect()
    out = []
    for r in (x.asDict() for x in rows):
        if "z" in r:
            p = 2 * D.norm_cdf(-abs(r["z"]))
        elif "t" in r:
            p = 0.0 if r["t"] is None or math.isinf(r["t"]) else D.t_sf2(r["t"], r["n"] - 2)
        elif "f" in r:
            p = 0.0 if r["f"] is None else D.f_sf(r["f"], r["d1"], r["d2"])
        else:
            p = D.chi2_sf(max(r["stat"], 0.0), r["df"])
        out.append({k: r[k] for k in ("feature", "metric", "value", "score", "n")} | {"p_value": p, "flag": r["score"] is not None and r["score"] >= threshold})
    for r, q in zip(out, p_adjust_list([r["p_value"] for r in out], adjust)):
        r |= {"p_value_adj": q, "flag_fdr": r["flag"] if adjust == "none" else q is not None and q <= alpha}
    return sorted(out, key=lambda r: (-(r["score"] if r["score"] is not None else -1), r["feature"]))


def p_adjust(df: DataFrame, p: str = "p_value", method: str = "BH", by: list[str] = ()) -> DataFrame:
    """df with p_value_adj by windows; null p stay null. Result tables have one row for each feature."""
    by = list(by)
    keyed = df.withColumn("__ok", F.col(p).isNotNull() & ~F.isnan(p))
    part = Window.partitionBy(*by, "__ok")
    m = F.count(F.lit(1)).over(part)
    rank = F.row_number().over(part.orderBy(p, *[c for c in df.columns if c not in (p, *by)]))
    harmonic = F.aggregate(F.sequence(F.lit(1), m.cast("int")), F.lit(0.0), lambda s, i: s + 1 / i.cast("double"))
    raw = {"BH": F.col(p) * F.col("__m") / F.col("__r"), "BY": F.col(p) * F.col("__m") / F.col("__r") * F.col("__h"), "holm": F.col(p) * (F.col("__m") - F.col("__r") + 1), "bonferroni": F.col(p) * F.col("__m"), "none": F.col(p)}
    if method not in raw:
        raise InputError("unknown adjustment")
    w = keyed.withColumns({"__m": m, "__r": rank}).withColumn("__h", harmonic if method == "BY" else F.lit(1.0)).withColumn("__q", raw[method])
    order = Window.partitionBy(*by, "__ok").orderBy("__r")
    q = {"BH": F.min("__q").over(order.rowsBetween(0, Window.unboundedFollowing)), "BY": F.min("__q").over(order.rowsBetween(0, Window.unboundedFollowing)), "holm": F.max("__q").over(order.rowsBetween(Window.unboundedPreceding, 0))}.get(method, F.col("__q"))
    return w.withColumn("p_value_adj", F.when(F.col("__ok"), F.least(q, F.lit(1.0)))).drop("__ok", "__m", "__r", "__h", "__q")


def p_adjust_list(values: list[float | None], method: str) -> list[float | None]:
    """The same for a list on the driver."""
    ok = sorted((i for i, v in enumerate(values) if v is not None and math.isfinite(v)), key=lambda i: values[i])
    m, out = len(ok), [None] * len(values)
    scale = sum(1 / k for k in range(1, m + 1)) if method == "BY" else 1.0
    if method in ("BH", "BY"):
        low = 1.0
        for r in range(m, 0, -1):
            low = min(low, values[ok[r - 1]] * m / r * scale)
            out[ok[r - 1]] = low
    elif method == "holm":
        high = 0.0
        for r, i in enumerate(ok):
            high = max(high, values[i] * (m - r))
            out[i] = min(1.0, high)
    else:
        for i in ok:
            out[i] = min(1.0, values[i] * m) if method == "bonferroni" else values[i]
    return out


def multivariate_scan(df: DataFrame, features: list[str], y: str, id_col: str, plan: SplitPlan, task: str, n: int = 100, components: int = 10, interactions: bool = True, seed: int = 1) -> dict:
    """Score of a linear model on principal components (of all rows) and products of the first five, out of fold, against permuted outcomes.

    Each permutation is one group of the design table of at most 20 columns;
    a group's folds are fitted in a task by numpy.
    """
    from larkspur.operators import guard as G

    stats = G.column_stats(df, features)
    names = [c for c in features if stats[c]["sd"]]
    z = df.select(id_col, F.col(y).cast("double").alias("y"), *[((F.coalesce(F.col(c), F.lit(stats[c]["median"])) - F.lit(stats[c]["mean"])) / F.lit(stats[c]["sd"])).alias(c) for c in names])
    k = min(components, len(names))
    axes = G.principal_axes(z, names, k)
    pcs = {f"PC{j + 1}": sum((F.col(c) * float(w) for c, w in zip(names, axes[:, j])), F.lit(0.0)) for j in range(k)}
    design = z.select(id_col, "y", *[e.alias(c) for c, e in pcs.items()])
    pairs = [(i, j) for i in range(1, min(5, k) + 1) for j in range(i + 1, min(5, k) + 1)] if interactions else []
    design = design.withColumns({f"PC{i}_x_PC{j}": F.col(f"PC{i}") * F.col(f"PC{j}") for i, j in pairs}) if pairs else design
    columns = [c for c in design.columns if c not in (id_col, "y")]
    folds = plan.assign.where("repeat_id = 1").select(id_col, "fold")
    found = _scan_tasks(design, id_col, columns, folds, task, n, seed)
    found = _scan_shuffled(design, id_col, columns, folds, task, n, seed) if found is None else found
    obs = next(r for r in found if r["b"] == 0)
    perm = [r["score"] for r in found if r["b"] > 0 and math.isfinite(r["score"])]
    return {"metric": "auc" if task == "binomial" else "cor", "value": obs["value"], "score": obs["score"], "p_value": (1 + sum(p >= obs["score"] for p in perm)) / (1 + len(perm)), "n": obs["n"], "n_features": len(names), "n_components": k, "n_interactions": len(pairs), "n_perm": len(perm)}


def _scan_tasks(design: DataFrame, id_col: str, columns: list[str], folds: DataFrame, task: str, n: int, seed: int) -> list | None:
    """Rows (b, value, score, n) of tasks that read one table; None beyond TASK_ROWS rows."""
    from larkspur.operators import refits

    binomial = task == "binomial"
    value = rank_auc if binomial else lambda t, p: float(np.corrcoef(t, p)[0, 1])
    with stored(refits.stored_rows(design, id_col, "y", columns, folds), "at", "id") as held:
        if held.rows > TASK_ROWS:
            return None
        found = refits.permuted_values(design.sparkSession, held, len(columns), n, seed, binomial, None, value)
    return [r.asDict() | {"score": abs(r["value"] - 0.5) * 2 if binomial else abs(r["value"])} for r in found]


def _scan_shuffled(design: DataFrame, id_col: str, columns: list[str], folds: DataFrame, task: str, n: int, seed: int) -> list:
    """The same by a shuffle of all permutations."""
    labels = P.shuffled(design, id_col, "y", n, seed).unionByName(design.select(F.lit(0).alias("b"), id_col, "y"))
    rows = labels.join(design.drop("y"), id_col).join(folds, id_col)

    def score(pdf):
        import pandas as pd

        x, t, fold, out = pdf[columns].to_numpy(), pdf["y"].to_numpy(), pdf["fold"].to_numpy(), np.full(len(pdf), np.nan)
        for f in np.unique(fold):
            tr = fold != f
            if len(np.unique(t[tr])) < 2:
                continue
            out[~tr] = predict_linear(fit_logistic(x[tr], t[tr]) if task == "binomial" else fit_ols(x[tr], t[tr]), x[~tr], task == "binomial")
        ok = np.isfinite(out)
        value = rank_auc(t[ok], out[ok]) if task == "binomial" else float(np.corrcoef(t[ok], out[ok])[0, 1])
        return pd.DataFrame({"b": [int(pdf["b"].iloc[0])], "value": [value], "score": [abs(value - 0.5) * 2 if task == "binomial" else abs(value)], "n": [int(ok.sum())]})

    return rows.groupBy("b").applyInPandas(score, "b int, value double, score double, n long").collect()


def fit_logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None, ridge: float = 1e-6, rounds: int = 25) -> np.ndarray:
    """Weights of a logistic model, the constant first, by Newton steps over FIT_ROWS rows at once."""
    w = np.zeros(x.shape[1] + 1)
    for _ in range(rounds):
        h, s = ridge * np.eye(len(w)), ridge * w
        for a, t, g in _slices(x, y, weights):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            h += (a * (g * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ a
            s += a.T @ (g * (p - t))
        step = np.linalg.solve(h, s)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit_ols(x: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None, ridge: float = 1e-9) -> np.ndarray:
    h, s = ridge * np.eye(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    for a, t, g in _slices(x, y, weights):
        h += (a * g[:, None]).T @ a
        s += a.T @ (g * t)
    return np.linalg.solve(h, s)


def _slices(x: np.ndarray, y: np.ndarray, weights: np.ndarray | None):
    """Rows with a constant first, outcomes and weights."""
    for i in range(0, len(x), FIT_ROWS):
        part = slice(i, i + FIT_ROWS)
        n = len(x[part])
        yield np.column_stack((np.ones(n), x[part])), y[part], np.ones(n) if weights is None else weights[part]


def predict_linear(w: np.ndarray, x: np.ndarray, logistic: bool) -> np.ndarray:
    s = w[0] + x @ w[1:]
    return 1 / (1 + np.exp(-np.clip(s, -30, 30))) if logistic else s


def midranks(p: np.ndarray) -> np.ndarray:
    """The mean rank (from 1) of each number among those that aren't NaN, which get NaN."""
    order = np.argsort(p)  # NaN last
    n = len(p) - int(np.isnan(p).sum())
    ranked = p[order[:n]]
    first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if n else np.empty(0, dtype=np.int64)
    size = np.diff(np.append(first, n))
    out = np.full(len(p), np.nan)
    out[order[:n]] = np.repeat(first + (size + 1) / 2, size)
    return out


def rank_auc(y: np.ndarray, p: np.ndarray) -> float:
    """AUC by midranks; NaN with one class."""
    mid = midranks(p)
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    return float((mid[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)) if n1 and n0 else math.nan


# -- near duplicates

BLOCK_ROWS = 1024  # of a block at least, and that are compared with another block at once
BLOCK_BYTES = 8 << 20  # of a block's vectors, if it has more rows
PLANES = 3


def near_duplicates(df: DataFrame, id_col: str, vector: str, threshold: float = 0.995, method: str = "cosine", space: str = "raw") -> DataFrame:
    """(i, j, sim), i < j: pairs whose similarity reaches the threshold; exact.

    method pearson centres each vector; space rank replaces components by their
    ranks within the column (midranks). Null or non-finite components count as
    the column's median. Unit vectors of a pair are at most sqrt(2 (1 - threshold))
    apart, so in every direction as well: rows fall into cells of that width
    along PLANES fixed directions, only cells that touch are compared, and which
    blocks meet is settled on a table of blocks before any vector is sent. Each
    pair of blocks is compared by matrix products in a task of bounded memory. A
    block is sent to every block that it meets, so blocks are as large as a task
    takes: what is sent is the table times the blocks that meet one. Where the
    threshold is low or all rows are alike, the work still grows with the square
    of the rows: that is the operator.
    """
    if method not in ("cosine", "pearson") or space not in ("raw", "rank"):
        raise InputError("unknown similarity")
    import pandas as pd

    base = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"))
    d = (base.agg(F.max(F.size("v"))).first()[0]) or 0
    if not d:
        return df.sparkSession.createDataFrame([], "i long, j long, sim double")
    clean = F.transform("v", lambda x: F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x.cast("double")))
    base = base.select("id", clean.alias("v"))
    long = base.select("id", F.posexplode("v").alias("k", "x"))
    has_holes = base.where(F.exists("v", lambda x: x.isNull())).limit(1).count() > 0
    if has_holes or space == "rank":
        medians = long.groupBy("k").agg(F.median("x").alias("m"))
        long = long.join(F.broadcast(medians), "k").select("id", "k", F.coalesce("x", "m").alias("x"))
        if space == "rank":
            ties = running(long.groupBy("k", "x").agg(F.count(F.lit(1)).alias("n")), ["k"], "x", {"c": "n"})
            long = long.join(ties.select("k", "x", (F.col("c") - (F.col("n") - 1) / 2).alias("r")), ["k", "x"]).select("id", "k", F.col("r").alias("x"))
        base = long.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("v"))
    width = math.sqrt(max(0.0, 2 * (1 - threshold))) + 1e-6
    planes = np.linalg.qr(np.random.default_rng(13).normal(size=(d, min(PLANES, d))))[0]

    def unit(batches):
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy()).astype(float)
                x = x - x.mean(axis=1, keepdims=True) if method == "pearson" else x
                norm = np.linalg.norm(x, axis=1, keepdims=True)
                x = x / np.where(norm > 0, norm, 1.0)
                cells = np.floor(x @ planes / width).astype(int)
                yield pd.DataFrame({"id": pdf["id"], "x": [r.tobytes() for r in x], "cell": list(cells)})

    rows = base.mapInPandas(unit, "id long, x binary, cell array<int>")
    counts = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / max(BLOCK_ROWS, BLOCK_BYTES // (8 * d))).cast("int").alias("blocks"))
    placed = rows.join(counts, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    table = placed.groupBy("cell", "part").agg(F.collect_list(F.struct("id", "x")).alias("rows"))
    # which blocks meet: each pair of parts of each two cells that touch, once
    offsets = F.array(*[F.array(*[F.lit(o) for o in step]) for step in itertools.product((-1, 0, 1), repeat=planes.shape[1])])
    near = counts.select(F.col("cell").alias("lo"), F.col("blocks").alias("nlo"), F.explode(F.transform(offsets, lambda o: F.zip_with("cell", o, lambda a, b: a + b))).alias("hi"))
    near = near.where(F.col("lo") <= F.col("hi")).join(counts.select(F.col("cell").alias("hi"), F.col("blocks").alias("nhi")), "hi")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    pairs = near.withColumn("plo", every("nlo")).withColumn("phi", every("nhi")).where((F.col("lo") < F.col("hi")) | (F.col("plo") <= F.col("phi")))
    pairs = pairs.select("lo", "plo", "hi", "phi", F.monotonically_increasing_id().alias("pair"))
    ends = F.explode(F.array_distinct(F.array(F.struct(F.col("lo").alias("cell"), F.col("plo").alias("part")), F.struct(F.col("hi").alias("cell"), F.col("phi").alias("part"))))).alias("e")
    from larkspur.operators.splits import checkpointed

    sent = checkpointed(pairs).select("pair", ends).select("pair", "e.cell", "e.part").join(table, ["cell", "part"])

    step = BLOCK_ROWS

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = [np.array([r["id"] for r in rows], dtype=np.int64) for rows in pdf["rows"]]
        x = [np.frombuffer(b"".join(r["x"] for r in rows)).reshape(-1, d) for rows in pdf["rows"]]
        out = []
        for at in range(0, len(x[0]), step):
            s = x[0][at : at + step] @ x[-1].T
            r, c = np.nonzero(s >= threshold)
            i, j, v = ids[0][at + r], ids[-1][c], s[r, c]
            keep = i < j if len(pdf) == 1 else i != j
            out.append(pd.DataFrame({"i": np.minimum(i, j)[keep], "j": np.maximum(i, j)[keep], "sim": v[keep]}))
        return pd.concat(out)

    return sent.select("pair", "rows").groupBy("pair").applyInPandas(compare, "i long, j long, sim double")


def cross_fold(pairs: DataFrame, plan: SplitPlan) -> DataFrame:
    """pairs with cross_fold: in some repeat the two rows lie in different folds; for time plans, one row may train the other's fold."""
    a = plan.assign.select(F.col(plan.id_col).alias("i"), "repeat_id", F.col("fold").alias("fi"))
    b = plan.assign.select(F.col(plan.id_col).alias("j"), "repeat_id", F.col("fold").alias("fj"))
    both = pairs.join(a, "i").join(b, ["j", "repeat_id"])
    if plan.mode != "time_series":
        flag = F.col("fi") != F.col("fj")
    else:
        from larkspur.operators.splits import as_number

        kind = plan.samples.schema[plan.info["time"]].dataType.typeName()
        t = plan.samples.select(plan.id_col, as_number(F.col(plan.info["time"]), kind).alias("t"))
        starts = plan.blocks().select("repeat_id", "fold", "tmin")
        both = both.join(t.select(F.col(plan.id_col).alias("i"), F.col("t").alias("ti")), "i").join(t.select(F.col(plan.id_col).alias("j"), F.col("t").alias("tj")), "j")
        both = both.join(F.broadcast(starts.withColumnsRenamed({"fold": "fi", "tmin": "mi"})), ["repeat_id", "fi"]).join(F.broadcast(starts.withColumnsRenamed({"fold": "fj", "tmin": "mj"})), ["repeat_id", "fj"])
        gap = plan.info["horizon"] * (1_000_000 if kind.startswith("timestamp") else 1)
        before = (lambda x, m: x <= m - gap) if gap else (lambda x, m: x < m)
        flag = before(F.col("tj"), F.col("mi")) | before(F.col("ti"), F.col("mj"))
    return both.groupBy("i", "j").agg(F.first("sim").alias("sim"), F.bool_or(flag).alias("cross_fold"))


def duplicates(df: DataFrame, plan: SplitPlan, vector: str, threshold: float = 0.995, method: str = "cosine", space: str = "raw", scope: str = "train_test", max_pairs: int = 5000) -> DataFrame:
    """(i, j, sim, cross_fold) by falling similarity, at most max_pairs (a report's length; near_duplicates has them all)."""
    found = cross_fold(near_duplicates(df, plan.id_col, vector, threshold, method, space), plan)
    found = found.where("cross_fold") if scope == "train_test" else found
    return found.orderBy(F.desc("sim"), "i", "j").limit(max_pairs)


# -- together


def mechanism_summary(gap: dict | None, batch: list[dict], target: list[dict], dups: DataFrame | None, split_mode: str) -> list[dict]:
    """One row for each mechanism: flagged, evidence, statistic, p_value."""
    number = lambda rows, k, f: f([r[k] for r in rows if r.get(k) is not None and math.isfinite(r[k])], default=None)
    dup = dups.agg(F.max("sim").alias("sim"), F.coalesce(F.bool_or("cross_fold"), F.lit(False)).alias("cross")).first() if dups is not None else {"sim": None, "cross": False}
    p, v = number(batch, "pval", min), number(batch, "cramer_v", max)
    out = {
        "non_random_signal": (bool(gap) and gap["p_value"] is not None and gap["p_value"] <= 0.05 and gap["gap"] is not None and gap["gap"] > 0, gap and gap["gap"], gap and gap["p_value"]),
        "confounding_alignment": (p is not None and p <= 0.05 and v is not None and v >= 0.1, v, p),
        "proxy_target_leakage": (any(r.get("flag_fdr") or r.get("flag") for r in target), number(target, "score", max), number(target, "p_value_adj", min)),
        "duplicate_overlap": (bool(dup["cross"]), dup["sim"], None),
        "temporal_lookahead": (split_mode == "time_series" and bool(dup["cross"]), None, None),
    }
    return [{"mechanism_class": m, "flagged": bool(out[m][0]), "evidence": e, "statistic": out[m][1], "p_value": out[m][2]} for m, e, _ in TAXONOMY]


@dataclass
class AuditResult:
    permutation_gap: dict
    perm_values: list[float]
    batch_assoc: list[dict]
    target_assoc: list[dict]
    duplicates: DataFrame | None
    mechanisms: list[dict]
    info: dict = field(default_factory=dict)

    def plot(self) -> list[dict]:
        """What a plot of the audit draws: the histogram of permuted values, and the observed one."""
        ok = [v for v in self.perm_values if v is not None]
        counts, edges = np.histogram(ok, 20) if ok else ([], [])
        return [{"lo": float(a), "hi": float(b), "n": int(n), "observed": self.permutation_gap["metric_obs"]} for a, b, n in zip(edges[:-1], edges[1:], counts)]

    def describe(self) -> str:
        g = self.permutation_gap
        lines = [f"{self.info['metric']}: {g['metric_obs']:.4g}, permuted {g['perm_mean']:.4g}, gap {g['gap']:.4g} ({gap_words(g['gap'])}), p {g['p_value']:.4g}"]
        return "\n".join(lines + [f"{m['mechanism_class']}: {'flagged' if m['flagged'] else 'not flagged'}" for m in self.mechanisms])


def gap_words(gap: float) -> str:
    return "little" if gap < 0.01 else "modest" if gap < 0.05 else "strong"


def audit_leakage(predictions: DataFrame, plan: SplitPlan, metric: str, task: str, n: int = 200, *, truth: str = "truth", pred: str = "pred", features: list[str] = (), categorical: list[str] = (), outcome: str | None = None, vector: str | None = None, samples: DataFrame | None = None, batch_columns: list[str] | None = None, threshold: float = 0.995, target_threshold: float = 0.9, adjust: str = "BH", ci_method: str = "if", boot: int = 1000, restricted: str | None = None, learner: str | None = None, seed: int = 1) -> AuditResult:
    """All audits of one learner's out-of-fold predictions.

    predictions: id, fold, truth, pred (and learner, where there are several).
    restricted names a permutation scheme other than the global one.
    """
    if "learner" in predictions.columns:
        learners = [r[0] for r in predictions.select("learner").distinct().limit(2).collect()]
        if learner is None and len(learners) > 1:
            raise AuditError("several learners: name one")
        predictions = predictions.where(F.col("learner") == (learner or learners[0]))
    samples = plan.samples if samples is None else samples
    rows = predictions.withColumn("__row", F.concat_ws("|", F.col(plan.id_col), "fold"))
    labels = None
    if restricted:
        i = plan.info
        labels = P.permuted_labels(rows.join(plan.samples, plan.id_col), "__row", truth, n, P.perm_mode(plan, restricted), seed, i["group"], i["batch"], i["study"], i["time"])
    values = [r["value"] for r in permutation_values(rows, "__row", metric, task, n, truth, pred, seed, labels).orderBy("b").collect()]
    obs = observed(rows, metric, task, truth, pred).first()["value"]
    higher = metric in M.HIGHER_IS_BETTER
    ok = [v for v in values if v is not None]
    mean = sum(ok) / len(ok) if ok else math.nan
    gap = (obs - mean) if higher else (mean - obs)
    se_obs = None
    if metric == "auc":
        se_obs = math.sqrt(M.pooled_cvauc(M.cvauc_if(rows, truth, pred, ["fold"])).first()["var_auc"] or 0.0)
    ci = U.se_ci_delta(gap, se_obs, ok) if ci_method == "if" else {"ci": U.bootstrap_gap_ci([(obs - v) if higher else (v - obs) for v in ok], boot, seed=seed)}
    gap_row = {"metric_obs": obs, "perm_mean": mean, "perm_sd": float(np.std(ok, ddof=1)) if len(ok) > 1 else math.nan, "gap": gap} | U.permutation_p(ok, obs, higher) | {"ci_lo": ci["ci"][0], "ci_hi": ci["ci"][1], "z": ci.get("z")}
    columns = batch_columns or [c for c in dict.fromkeys([*BATCH_COLUMNS, plan.info["batch"], plan.info["study"]]) if c and c in samples.columns]
    batch = with_pvalues(batch_assoc(plan, samples, columns)) if columns else []
    target = target_scan(samples, outcome, task, list(features), list(categorical), target_threshold, adjust) if outcome and (features or categorical) else []
    dups = duplicates(samples, plan, vector, threshold) if vector else None
    info = {"metric": metric, "task": task, "n_perm": n, "seed": seed, "mode": plan.mode, "learner": learner, "restricted": restricted, "threshold": threshold, "target_threshold": target_threshold, "adjust": adjust, "ci_method": ci_method, "batch_columns": columns}
    info["hash"] = hashlib.sha256(json.dumps(info, sort_keys=True, default=str).encode()).hexdigest()
    return AuditResult(gap_row, values, batch, target, dups, mechanism_summary(gap_row, batch, target, dups, plan.mode), info)


def tuned_predictions(outer: DataFrame) -> DataFrame:
    """The outer predictions of a tuning result as those of one learner: fold is the outer fold's place among all repeats."""
    order = Window.orderBy("outer_repeat", "outer_fold")  # one row for each outer fold
    folds = outer.select("outer_repeat", "outer_fold").distinct().withColumn("fold", F.row_number().over(order).cast("int"))
    return outer.join(F.broadcast(folds), ["outer_repeat", "outer_fold"]).drop("outer_repeat", "outer_fold").withColumn("learner", F.lit("tuned"))


def audit_tuned(result, plan: SplitPlan, metric: str = "auc", n: int = 200, **more) -> AuditResult:
    """All audits of a tuning result's outer predictions."""
    if result.outer.limit(1).count() == 0:
        raise AuditError("the tuning result holds no outer predictions")
    return audit_leakage(tuned_predictions(result.outer), plan, metric, "binomial", n, learner="tuned", **more)


def audit_by_learner(predictions: DataFrame, plan: SplitPlan, metric: str, task: str, n: int = 200, **more) -> dict[str, AuditResult]:
    learners = [r[0] for r in predictions.select("learner").distinct().orderBy("learner").collect()]
    return {x: audit_leakage(predictions, plan, metric, task, n, learner=x, **more) for x in learners}


def gaps_by_learner(predictions: DataFrame, id_col: str, n: int, seed: int = 1, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """(learner, metric_obs, perm_mean, gap): AUC gaps of all learners in one job; the learner is one more key."""
    labels = P.shuffled(predictions, id_col, truth, n, seed, ["learner"])
    scored = labels.join(predictions.select(id_col, "learner", pred), id_col)
    perm = M.auc(scored, truth, pred, ["learner", "b"]).groupBy("learner").agg(F.avg("auc").alias("perm_mean"))
    obs = M.auc(predictions, truth, pred, ["learner"]).withColumnRenamed("auc", "metric_obs")
    return obs.join(perm, "learner").withColumn("gap", F.col("metric_obs") - F.col("perm_mean"))
