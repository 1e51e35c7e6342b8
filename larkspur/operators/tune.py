"""Choices made inside nested cross-validation: thresholds, configurations, final parameters."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.errors import FoldWarning, InputError, ValidationWarning, warn
from larkspur.operators import metrics as M
from larkspur.operators.uncertainty import cv_ci

GRID = [round(0.1 + 0.05 * i, 2) for i in range(17)]
EPS = 1.490116e-08


def threshold_select(df: DataFrame, truth: str = "truth", pred: str = "pred", metric: str = "f1", grid: list[float] | None = None, by: list[str] = ()) -> DataFrame:
    """by, threshold, value: the threshold of the largest metric; ties to the one nearest 0.5, then the smaller; 0.5 where none has a value."""
    by = list(by)
    scores = M.threshold_metrics(df, grid or GRID, truth, pred, by).select(*by, "threshold", F.col(metric).alias("value"))
    order = F.struct(-F.col("value"), F.round(F.abs(F.col("threshold") - 0.5), 9), F.col("threshold"))
    best = scores.groupBy(*by).agg(F.min_by(F.struct("threshold", "value"), F.when(F.col("value").isNotNull(), order)).alias("m"))
    return best.select(*by, F.coalesce("m.threshold", F.lit(0.5)).alias("threshold"), F.col("m.value").alias("value"))


def config_table(scores: DataFrame, by: list[str] = (), config: str = "config", value: str = "value") -> DataFrame:
    """by, config, mean, sd, n, se over finite inner folds."""
    ok = scores.where(F.col(value).isNotNull() & ~F.isnan(value))
    return ok.groupBy(*by, config).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(F.lit(1)).alias("n")).withColumn("se", F.col("sd") / F.sqrt("n"))


def select_config(scores: DataFrame, params: DataFrame, simpler: dict[str, str], rule: str = "best", higher: bool = True, by: list[str] = (), config: str = "config") -> DataFrame:
    """by, config, mean: best within sqrt(eps), or within one standard error of the best; of those the simplest by rank sum over params, then the smallest name.

    simpler: parameter -> "asc" or "desc", the direction that is simpler.
    """
    if rule not in ("best", "one_std_err"):
        raise InputError("rule is best or one_std_err")
    by = list(by)
    t = config_table(scores, by, config)
    sign = 1 if higher else -1
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # one row for each configuration
    t = t.withColumn("s", F.col("mean") * sign)
    top = F.max("s").over(w)
    slack = F.lit(EPS) if rule == "best" else F.coalesce(F.max_by("se", F.struct("s", F.col(config))).over(w), F.lit(0.0))
    near = t.withColumn("ok", F.col("s") >= top - slack).where("ok").join(params, config)
    ranks = sum([F.rank().over((w).orderBy(F.col(p).asc() if d == "asc" else F.col(p).desc())) for p, d in simpler.items()], F.lit(0))
    pick = near.withColumn("simple", ranks).withColumn("rn", F.row_number().over(w.orderBy("simple", config)))
    return pick.where("rn = 1").select(*by, config, "mean")


def aggregate_params(best: DataFrame, numeric: list[str], categorical: list[str] = ()) -> DataFrame:
    """One row: medians of numbers, most frequent values of others (ties to the smallest), over outer folds."""
    votes = {c: best.where(F.col(c).isNotNull()).groupBy(c).count().agg(F.min_by(c, F.struct(-F.col("count"), F.col(c))).alias(c)) for c in categorical}
    out = best.agg(*[F.percentile(c, F.lit(0.5)).alias(c) for c in numeric]) if numeric else best.limit(1).select()
    for v in votes.values():
        out = out.join(F.broadcast(v))
    return out


def grid(**values: list) -> list[dict]:
    """All combinations, each with a name."""
    names = list(values)
    return [dict(zip(names, combo)) | {"config": f"c{i:03d}"} for i, combo in enumerate(itertools.product(*values.values()), 1)]


def usable_metrics(metrics: list[str], inner: DataFrame, truth: str = "truth", by: list[str] = ("outer_repeat", "outer_fold", "fold")) -> list[str]:
    """metrics (roc_auc is auc) without those that need both classes, where an inner assessment fold has one class only. inner: by, truth."""
    named = list(dict.fromkeys("auc" if m == "roc_auc" else m for m in metrics))
    if bad := [m for m in named if m not in M.APPLICABLE["binomial"]]:
        warn(f"metrics that don't apply to binomial outcomes are left out: {bad}", ValidationWarning)
    named = [m for m in named if m in M.APPLICABLE["binomial"]]
    need = [m for m in named if m in ("auc", "pr_auc")]
    if need and inner.groupBy(*by).agg(F.count_distinct(truth).alias("n")).where("n < 2").limit(1).count():
        warn(f"inner folds of one class: {need} are left out", FoldWarning)
        named = [m for m in named if m not in need]
    return named or ["accuracy"]


def threshold_stability(thresholds: DataFrame) -> DataFrame:
    """n, mean, sd, lo, hi of the thresholds that outer folds chose."""
    return thresholds.agg(F.count("threshold").alias("n"), F.avg("threshold").alias("mean"), F.stddev_samp("threshold").alias("sd"), F.min("threshold").alias("lo"), F.max("threshold").alias("hi"))


def outer_status(outer_folds: DataFrame, best: DataFrame, scored: DataFrame) -> DataFrame:
    """outer_repeat, outer_fold, status, reason: failed where no configuration has a score, skipped where the tuned model predicts nothing. All arguments: outer_repeat, outer_fold."""
    by = ["outer_repeat", "outer_fold"]
    told = outer_folds.select(*by).distinct().join(best.select(*by).distinct().withColumn("b", F.lit(1)), by, "left").join(scored.select(*by).distinct().withColumn("s", F.lit(1)), by, "left")
    status = F.when(F.col("b").isNull(), "failed").when(F.col("s").isNull(), "skipped").otherwise("success")
    reason = F.when(F.col("b").isNull(), "no_valid_metrics").when(F.col("s").isNull(), "single_class_training").otherwise("")
    return told.select(*by, status.alias("status"), reason.alias("reason"))


@dataclass
class TuneResult:
    scores: DataFrame  # outer_repeat, outer_fold, inner_fold, config, value
    best: DataFrame  # outer_repeat, outer_fold, config, mean
    thresholds: DataFrame | None
    outer: DataFrame  # id, outer fold's out-of-fold predictions
    final: dict
    info: dict = field(default_factory=dict)
    fold_status: DataFrame | None = None  # outer_repeat, outer_fold, status, reason

    def metrics(self) -> DataFrame:
        """repeat_id, fold, learner, and the metric of each outer fold."""
        named = self.outer.withColumnsRenamed({"outer_repeat": "repeat_id", "outer_fold": "fold"})
        return M.evaluate(named, self.info["metric"], "binomial", "truth", "pred", ["repeat_id", "fold"]).withColumn("learner", F.lit("tuned"))

    def summary(self, level: float = 0.95) -> list[dict]:
        """Mean, deviation and interval of the outer folds' metric. Sizes of train sets aren't known here, so the variance is divided by the folds."""
        return cv_ci(self.metrics(), [self.info["metric"]], level, "nadeau_bengio")

    def stability(self) -> DataFrame | None:
        return None if self.thresholds is None else threshold_stability(self.thresholds)

    def describe(self) -> str:
        r = self.summary()[0]
        return f"{r['metric']}: {r['mean']:.4g} over outer folds, final {self.final}"


def tune_resample(df: DataFrame, outcome: str, features: list[str], plan, configs: list[dict], simpler: dict[str, str], inner_v: int = 3, metric: str = "auc", rule: str = "best", tune_threshold: bool = False, threshold_metric: str = "f1") -> TuneResult:
    """Nested cross-validation of the ridge-penalised logistic learner: all outer folds, inner folds and configurations are groups of one job."""
    from larkspur.operators.resample import logistic_predictions
    from larkspur.operators.splits import checkpointed, nested_plan

    spark, id_col = df.sparkSession, plan.id_col
    params = spark.createDataFrame([(c["config"], *[float(c[k]) for k in c if k != "config"]) for c in configs], ["config", *[k for k in configs[0] if k != "config"]])
    inner = nested_plan(plan, inner_v)
    inner_pred = checkpointed(logistic_predictions(df, outcome, features, id_col, inner.withColumnRenamed("inner_fold", "fold"), configs, ["outer_repeat", "outer_fold"]))
    metric = usable_metrics([metric], inner_pred)[0]
    scores = checkpointed(M.evaluate(inner_pred, metric, "binomial", "truth", "pred", ["outer_repeat", "outer_fold", "fold", "config"]).withColumnsRenamed({metric: "value", "fold": "inner_fold"}))
    best = checkpointed(select_config(scores, params, simpler, rule, True, ["outer_repeat", "outer_fold"]))
    thresholds = threshold_select(inner_pred.join(best.select("outer_repeat", "outer_fold", "config"), ["outer_repeat", "outer_fold", "config"]), "truth", "pred", threshold_metric, by=["outer_repeat", "outer_fold"]) if tune_threshold else None
    every = logistic_predictions(df, outcome, features, id_col, plan.assign, configs, ["repeat_id"]).withColumnsRenamed({"repeat_id": "outer_repeat", "fold": "outer_fold"})
    outer = every.join(best.select("outer_repeat", "outer_fold", "config"), ["outer_repeat", "outer_fold", "config"])
    if thresholds is not None:
        outer = outer.join(thresholds.select("outer_repeat", "outer_fold", "threshold"), ["outer_repeat", "outer_fold"]).withColumn("pred_class", (F.col("pred") >= F.col("threshold")).cast("int"))
    outer = checkpointed(outer)
    numeric = [k for k in configs[0] if k != "config"]
    final = aggregate_params(best.join(params, "config"), numeric).first().asDict()
    status = outer_status(plan.assign.withColumnsRenamed({"repeat_id": "outer_repeat", "fold": "outer_fold"}), best, outer.where("pred is not null and not isnan(pred)"))
    return TuneResult(scores, best, thresholds, outer, final, {"rule": rule, "metric": metric}, status)
