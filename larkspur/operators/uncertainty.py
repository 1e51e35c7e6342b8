"""Intervals for cross-validated metrics and permutation gaps. Aggregates are made in Spark, quantiles on the driver."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.errors import InputError
from larkspur.functions.stats_dist import norm_ppf, t_ppf

SMALL = 30  # below so many values, Student's t


def finite(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x)


def corrected_variance(v: Column, k: Column, n_train: float | None, n_test: float | None) -> Column:
    """(1/K + n_test/n_train) v, or v/K where sizes aren't given."""
    return v * (1 / k + n_test / n_train) if n_train and n_test is not None else v / k


def cv_summary(metrics: DataFrame, columns: list[str], n_train: float | None = None, n_test: float | None = None, by: str = "learner") -> DataFrame:
    """(by, metric, k, mean, sd, se, se_nb) over finite fold values; se_nb is corrected for the overlap of train sets."""
    long = metrics.select(by, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), finite(c).alias("v")) for c in columns])).alias("m")).select(by, "m.*")
    agg = long.groupBy(by, "metric").agg(F.count("v").alias("k"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.var_samp("v").alias("var"))
    many = F.col("k") >= 2
    return agg.select(by, "metric", "k", "mean", F.when(many, F.col("sd")).alias("sd"), F.when(many, F.col("sd") / F.sqrt("k")).alias("se"), F.when(many, F.sqrt(corrected_variance(F.col("var"), F.col("k"), n_train, n_test))).alias("se_nb"))


def quantile_for(k: int, level: float) -> float:
    p = 1 - (1 - level) / 2
    return t_ppf(p, k - 1) if k < SMALL else norm_ppf(p)


def cv_ci(metrics: DataFrame, columns: list[str] | None = None, level: float = 0.95, method: str = "normal", n_train: float | None = None, n_test: float | None = None) -> list[dict]:
    """One dict for each learner and metric: mean, sd, ci_lo, ci_hi; intervals need two finite folds."""
    columns = columns or [c for c, kind in metrics.dtypes if c not in ("fold", "repeat_id", "learner") and kind in ("double", "float", "int", "bigint")]
    if not columns or not 0 < level < 1 or method not in ("normal", "nadeau_bengio"):
        raise InputError("metric columns, a level within 0 and 1, and a known method are needed")
    out = []
    for r in cv_summary(metrics, columns, n_train, n_test).orderBy("learner", "metric").collect():
        se = r["se"] if method == "normal" else r["se_nb"]
        half = quantile_for(r["k"], level) * se if r["k"] >= 2 else None
        out.append({"learner": r["learner"], "metric": r["metric"], "mean": r["mean"], "sd": r["sd"], "ci_lo": None if half is None else r["mean"] - half, "ci_hi": None if half is None else r["mean"] + half})
    return out


def se_ci_delta(delta: float, se_obs: float | None, perm_values: list[float], level: float = 0.95) -> dict:
    """Standard error, interval (6 digits) and z of a gap, from the observed error and the permutations' spread."""
    values = [v for v in perm_values if v is not None and math.isfinite(v)]
    none = {"se": math.nan, "ci": (math.nan, math.nan), "z": math.nan}
    if len(values) < 2:
        return none
    mean = math.fsum(values) / len(values)
    var = math.fsum((v - mean) ** 2 for v in values) / (len(values) - 1)
    own = se_obs if se_obs is not None and math.isfinite(se_obs) else 0.0
    if var == 0:
        se, q = own, norm_ppf(1 - (1 - level) / 2)
    else:
        se, q = math.sqrt(own**2 + var / len(values)), quantile_for(len(values), level)
    return {"se": se, "ci": (round(delta - q * se, 6), round(delta + q * se, 6)), "z": delta / se if se > 0 else math.nan}


def permutation_p(values: list[float], observed: float, higher: bool = True) -> dict:
    """(1 + as extreme) / (1 + B), and its Monte Carlo error."""
    ok = [v for v in values if v is not None and math.isfinite(v)]
    hits = sum(v >= observed if higher else v <= observed for v in ok)
    p = (1 + hits) / (1 + len(ok))
    return {"p_value": p, "p_se": math.sqrt(p * (1 - p) / (len(ok) + 1)), "n_perm": len(ok)}


def bootstrap_gap_ci(gaps: list[float], boot: int = 1000, level: float = 0.95, seed: int = 1) -> tuple[float, float]:
    """Percentile interval of the mean of resampled values."""
    import numpy as np

    values = np.array([g for g in gaps if g is not None and math.isfinite(g)])
    if len(values) < 2:
        return math.nan, math.nan
    rng = np.random.default_rng(seed)
    means = values[rng.integers(0, len(values), (boot, len(values)))].mean(axis=1)
    lo, hi = np.quantile(means, [(1 - level) / 2, 1 - (1 - level) / 2])
    return float(lo), float(hi)
