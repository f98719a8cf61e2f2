"""Windowed reduction of streamed metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_metrics(
    metrics: DataFrame, length: str, lateness: str = "0 seconds", keys: tuple[str, ...] = ("name",), time: str = "ts"
) -> DataFrame:
    """Mean, sum, min, max and count per window and name; a window is final once the watermark passes its end."""
    return (
        metrics.withWatermark(time, lateness)
        .groupBy(F.window(time, length), *keys)
        .agg(
            F.count("value").alias("n"),
            F.avg("value").alias("mean"),
            F.sum("value").alias("total"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
        )
        .select(F.col("window.start").alias("window_start"), *keys, "n", "mean", "total", "min", "max")
    )
