"""Tables behind diagnostic plots. Rendering is left to the report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.errors import InputError
from larkspur.operators import metrics as M
from larkspur.operators.splits import SplitPlan, as_number, check_split_overlap


def calibration_curve(df: DataFrame, truth: str = "truth", pred: str = "pred", bins: int = 10) -> DataFrame:
    """(bin, n, mean_pred, obs_rate, lo, hi): equal-width bins, closed at the right, the first at both ends; predictions are clipped to [0, 1]."""
    p = F.least(F.greatest(F.col(pred).cast("double"), F.lit(0.0)), F.lit(1.0))
    rows = df.where(F.col(truth).isNotNull() & F.col(pred).isNotNull()).select(F.col(truth).cast("double").alias("t"), p.alias("p"))
    bin_ = F.greatest(F.lit(1), F.ceil(F.col("p") * bins)).cast("int")
    return rows.withColumn("bin", bin_).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_pred"), F.avg("t").alias("obs_rate"), F.min("p").alias("lo"), F.max("p").alias("hi"))


def calibration_plot(df: DataFrame, truth: str = "truth", pred: str = "pred", bins: int = 10, min_bin_n: int = 5) -> DataFrame:
    """The calibration curve's bins of at least min_bin_n rows."""
    return calibration_curve(df, truth, pred, bins).where(F.col("n") >= min_bin_n)


def plot(result, which: str = "fold_balance", **more) -> DataFrame | list[dict]:
    """What a plot of a result draws: an audit's permutations, a fit's folds (fold_balance, calibration, overlap, acf, confounders), an inflation's repeats."""
    if hasattr(result, "perm_values"):
        return result.plot()
    if hasattr(result, "repeats"):
        return result.repeats
    spec = result.info["refit"]
    own = result.predictions
    if which == "fold_balance":
        return fold_balance(own, "truth", **more)
    if which == "calibration":
        return calibration_plot(own, **more)
    if which == "overlap":
        return overlap_counts(spec["plan"], **more)
    if which == "acf":
        return autocorrelation(own.join(spec["df"].select(spec["plan"].id_col, more["time"]), spec["plan"].id_col), more.pop("time"), "pred", spec["plan"].id_col, **more)
    if which == "confounders":
        side = spec["df"].select(spec["plan"].id_col, *more["confounders"])
        return confounder_sensitivity(own.join(side, spec["plan"].id_col), **more)
    raise InputError("which is fold_balance, calibration, overlap, acf or confounders")


def calibration_summary(df: DataFrame, truth: str = "truth", pred: str = "pred", bins: int = 10) -> DataFrame:
    """(ece, mce, brier, n) over all bins."""
    curve = calibration_curve(df, truth, pred, bins)
    gap = F.abs(F.col("mean_pred") - F.col("obs_rate"))
    p = F.least(F.greatest(F.col(pred).cast("double"), F.lit(0.0)), F.lit(1.0))
    brier = df.where(F.col(truth).isNotNull() & F.col(pred).isNotNull()).agg(F.avg(F.pow(F.col(truth) - p, 2)).alias("brier"))
    return curve.agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"), F.sum("n").alias("n")).join(F.broadcast(brier)).select("ece", "mce", "brier", "n")


def confounder_sensitivity(df: DataFrame, confounders: list[str], metric: str = "auc", task: str = "binomial", truth: str = "truth", pred: str = "pred", min_n: int = 10, numeric_bins: int = 4) -> DataFrame:
    """(confounder, level, n, positive_rate, value): the metric within each level; null for fewer than min_n rows.

    Numbers of more than numeric_bins values are cut at their quantiles. All
    confounders are unpivoted and scored together.
    """
    numeric = [c for c in confounders if df.schema[c].dataType.typeName() in ("double", "float", "long", "integer", "short")]
    parts = {}
    if numeric:
        cuts = df.agg(*[e for i, c in enumerate(numeric) for e in (F.percentile(c, F.array(*[F.lit(k / numeric_bins) for k in range(1, numeric_bins)])).alias(f"q{i}"), F.approx_count_distinct(c).alias(f"d{i}"))]).first()
        for i, c in enumerate(numeric):
            many = cuts[f"d{i}"] > numeric_bins
            q = sorted(set(cuts[f"q{i}"] or []))
            parts[c] = F.concat(F.lit("q"), sum([(F.col(c) > v).cast("int") for v in q], F.lit(1)).cast("string")) if many else F.col(c).cast("string")
    levels = F.array(*[F.struct(F.lit(c).alias("confounder"), F.coalesce(parts.get(c, F.col(c).cast("string")), F.lit(None)).alias("level")) for c in confounders])
    long = df.select(truth, pred, F.explode(levels).alias("c")).select(truth, pred, "c.*").where("level is not null")
    by = ["confounder", "level"]
    value = M.evaluate(long, metric, task, truth, pred, by).withColumnRenamed(metric, "value")
    size = long.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(truth) == 1).cast("double")).alias("positive_rate"))
    return size.join(value, by, "left").select(*by, "n", "positive_rate", F.when(F.col("n") >= min_n, F.col("value")).alias("value"))


def fold_balance(df: DataFrame, truth: str = "truth", by: list[str] = ("fold",)) -> DataFrame:
    """by, level, n, share: outcome counts of each fold."""
    counts = df.groupBy(*by, F.col(truth).cast("string").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def overlap_counts(plan: SplitPlan, column: str) -> DataFrame:
    return check_split_overlap(plan, [column])


def histogram(df: DataFrame, column: str, bins: int | None = None) -> DataFrame:
    """(bin, lo, hi, n): equal widths; their number by the Freedman-Diaconis rule unless given."""
    s = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.percentile(column, F.array(F.lit(0.25), F.lit(0.75))).alias("q"), F.count(column).alias("n")).first()
    if not s["n"] or s["hi"] == s["lo"]:
        return df.where(F.col(column).isNotNull()).groupBy(F.lit(1).alias("bin")).agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count(F.lit(1)).alias("n"))
    if bins is None:
        width = 2 * (s["q"][1] - s["q"][0]) / s["n"] ** (1 / 3)
        bins = max(1, min(1000, int(-(-(s["hi"] - s["lo"]) // width)))) if width > 0 else 30
    step = (s["hi"] - s["lo"]) / bins
    at = F.least(F.floor((F.col(column) - s["lo"]) / step), F.lit(bins - 1)).cast("int") + 1
    return df.where(F.col(column).isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n")).select("bin", (F.lit(s["lo"]) + (F.col("bin") - 1) * step).alias("lo"), (F.lit(s["lo"]) + F.col("bin") * step).alias("hi"), "n")


def autocorrelation(df: DataFrame, time: str, value: str, id_col: str, lags: int = 20) -> DataFrame:
    """(lag, acf, bound): autocorrelation in time order with the global mean and divisor n; bound is 1.96 / sqrt(n).

    Each row meets its next ``lags`` rows through an equality join on its place.
    """
    from larkspur.ids import value_ranked

    kind = df.schema[time].dataType.typeName()
    ok = df.where(F.col(value).isNotNull()).select(id_col, as_number(F.col(time), kind).alias("__t"), F.col(value).cast("double").alias("v"))
    s = ok.agg(F.avg("v").alias("m"), F.count(F.lit(1)).alias("n"), F.var_pop("v").alias("s")).first()
    ranked = value_ranked(ok, [], "__t", id_col, name="i").select("i", (F.col("v") - F.lit(s["m"] or 0.0)).alias("d"))
    ahead = ranked.select(F.explode(F.sequence(F.lit(0), F.lit(lags))).alias("lag"), "i", "d").withColumn("j", F.col("i") + F.col("lag"))
    pairs = ahead.join(ranked.select(F.col("i").alias("j"), F.col("d").alias("e")), "j")
    total = (s["s"] or 0.0) * (s["n"] or 0)
    return pairs.groupBy("lag").agg((F.sum(F.col("d") * F.col("e")) / F.lit(total or None)).alias("acf")).withColumn("bound", F.lit(1.96) / F.sqrt(F.lit(float(s["n"] or 1))))
