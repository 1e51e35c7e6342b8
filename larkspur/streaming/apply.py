"""Fitted models and windowed monitors over Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators.guard import GuardModel


def transform_stream(stream: DataFrame, model: GuardModel, keep: list[str]) -> DataFrame:
    """A fitted guard applied to a stream: one projection, without state. kNN and forest fills work batch-wise too."""
    return model.transform(stream, keep)


def monitor(stream: DataFrame, time: str, truth: str = "truth", pred: str = "pred", window: str = "1 hour", slide: str | None = None, lateness: str = "10 minutes", bins: int = 10) -> DataFrame:
    """(start, end, bin, n, mean_pred, obs_rate) by window and calibration bin; rows later than the watermark are left out."""
    p = F.least(F.greatest(F.col(pred).cast("double"), F.lit(0.0)), F.lit(1.0))
    at = F.window(time, window, slide) if slide else F.window(time, window)
    bin_ = F.greatest(F.lit(1), F.ceil(p * bins)).cast("int")
    agg = stream.withWatermark(time, lateness).groupBy(at.alias("w"), bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_pred"), F.avg(F.col(truth).cast("double")).alias("obs_rate"))
    return agg.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "bin", "n", "mean_pred", "obs_rate")
