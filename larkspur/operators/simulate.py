"""Synthetic data with a known leak, and detection rates over many of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.errors import InputError
from larkspur.functions.stats_dist import norm_ppf

LEAKAGES = ("none", "subject_overlap", "batch_confounded", "peek_norm", "lookahead")
#: rows and columns of the built-in profiles
PROFILES = {"omics": (220, 800), "imaging": (500, 120), "ehr": (1400, 60)}


def simulate_dataset(spark: SparkSession, n: int, p: int, leakage: str = "none", prevalence: float = 0.5, rho: float = 0.0, signal: float = 1.0, seed: int = 1) -> DataFrame:
    """row_id, subject, batch, study, time, y, x01..xp, and leak where there is one.

    Features are standard normal by hash of (seed, row, column); with rho they
    are autoregressive over rows, made column by column. The outcome is a
    probit of the scaled sum of the first five.
    """
    if leakage not in LEAKAGES:
        raise InputError("unknown leakage")
    names = [f"x{j:0{max(2, len(str(p)))}d}" for j in range(1, p + 1)]
    base = spark.range(1, n + 1).withColumnRenamed("id", "row_id")
    u = lambda *parts: (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.lit(str(x)) if not hasattr(x, "_jc") else x.cast("string") for x in parts])), 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)
    row = F.col("row_id")
    normal = lambda c: F.sqrt(-2 * F.log(u("a", c, row))) * F.cos(2 * np.pi * u("b", c, row))
    df = base.select("row_id", ((row - 1) % max(2, n // 5) + 1).alias("subject"), ((row - 1) % 6 + 1).alias("batch"), ((row - 1) % 4 + 1).alias("study"), row.alias("time"), *[normal(c).alias(c) for c in names])
    if rho:
        long = df.select("row_id", F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("x")) for c in names])).alias("s")).select("row_id", "s.*")

        def chain(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("row_id")
            x, root = pdf["x"].to_numpy().copy(), np.sqrt(1 - rho * rho)
            for i in range(1, len(x)):
                x[i] = rho * x[i - 1] + root * x[i]
            return pdf.assign(x=x)

        wide = long.groupBy("c").applyInPandas(chain, long.select("row_id", "c", "x").schema).groupBy("row_id").pivot("c", names).agg(F.first("x"))
        df = df.drop(*names).join(wide, "row_id")
    drive = names[: min(5, p)]
    line = sum((F.col(c) for c in drive), F.lit(0.0)) * (signal / np.sqrt(len(drive)))
    shift = norm_ppf(prevalence) * np.sqrt(1 + signal**2)
    df = df.withColumn("__l", line + F.lit(shift) + F.sqrt(-2 * F.log(u("e", row))) * F.cos(2 * np.pi * u("f", row))).withColumn("y", (F.col("__l") > 0).cast("int")).drop("__l")
    if leakage == "subject_overlap":
        df = df.withColumn("leak", F.avg("y").over(Window.partitionBy("subject")))
    elif leakage == "batch_confounded":
        df = df.withColumn("leak", F.avg("y").over(Window.partitionBy("batch")))
    elif leakage == "peek_norm":
        s = df.agg(F.avg("y").alias("m"), F.stddev_samp("y").alias("s")).first()
        df = df.withColumn("leak", (F.col("y") - s["m"]) / (s["s"] or 1.0))
    elif leakage == "lookahead":
        nxt = df.select((F.col("row_id") - 1).alias("row_id"), F.col("y").cast("double").alias("leak"))
        df = df.join(nxt, "row_id", "left").withColumn("leak", F.coalesce("leak", F.col("y").cast("double")))
    return df


RUNS = 12  # simulated studies that are fitted in one job


def _studies(spark: SparkSession, runs: list[dict], permutations: int, signal: float) -> list[dict]:
    """metric_obs, gap and p_value of each run (n, p, mode, leakage, seed); a run is one more key of the fits."""
    from larkspur.operators.resample import gap_of, refit_rows, refit_scores
    from larkspur.operators.splits import make_split_plan

    out = []
    for at in range(0, len(runs), RUNS):
        every = None
        for k, r in enumerate(runs[at : at + RUNS]):
            df = simulate_dataset(spark, r["n"], r["p"], r["leakage"], signal=signal, seed=r["seed"])
            plan = make_split_plan(df, r["mode"], id_col="row_id", group="subject", batch="batch", study="study", time="time", outcome="y", seed=r["seed"], check=False)
            rows = refit_rows(df, "y", plan, [c for c in df.columns if c.startswith("x") or c == "leak"], permutations, r["seed"]).withColumn("run", F.lit(k))
            every = rows if every is None else every.unionByName(rows)
        values: dict[int, dict] = {}
        for r in refit_scores(every, ["run"]).collect():  # one row for each run and permutation
            values.setdefault(r["run"], {})[r["b"]] = r["auc"]
        out += [gap_of(values[k]) for k in range(len(runs[at : at + RUNS]))]
    return out


def simulate_suite(spark: SparkSession, seeds: list[int], n: int = 200, p: int = 10, mode: str = "subject_grouped", leakage: str = "none", permutations: int = 20, signal: float = 1.0) -> DataFrame:
    """(seed, metric_obs, gap, p_value, leakage, mode): one simulated study for each seed; the fits of several studies, all permutations and folds are one job."""
    gaps = _studies(spark, [{"n": n, "p": p, "mode": mode, "leakage": leakage, "seed": s} for s in seeds], permutations, signal)
    rows = [(s, g["metric_obs"], g["gap"], g["p_value"], leakage, mode) for s, g in zip(seeds, gaps)]
    return spark.createDataFrame(rows, "seed int, metric_obs double, gap double, p_value double, leakage string, mode string")


def benchmark_suite(spark: SparkSession, profiles: dict[str, tuple[int, int]], leakages: list[str], modes: list[str], seeds: list[int], permutations: int = 20, alpha: float = 0.05) -> DataFrame:
    """(modality, leakage, mode, n_runs, detection_rate): detected where p is at most alpha and the gap positive."""
    runs = [{"modality": name, "n": n, "p": p, "leakage": leakage, "mode": mode, "seed": seed} for name, (n, p) in profiles.items() for leakage in leakages for mode in modes for seed in seeds]
    rows = [(r["modality"], r["leakage"], r["mode"], float(g["p_value"] <= alpha and g["gap"] > 0)) for r, g in zip(runs, _studies(spark, runs, permutations, 1.0))]
    table = spark.createDataFrame(rows, "modality string, leakage string, mode string, hit double")
    return table.groupBy("modality", "leakage", "mode").agg(F.count(F.lit(1)).alias("n_runs"), F.avg("hit").alias("detection_rate"))
