"""Experiment results as JSON datasets: raw samples, statistics and metadata side by side under one folder."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators.stats import analyze, name_table
from tidelog.schemas import TIMING

STATISTICS = (
    "experiment string, count bigint, q1 double, median double, q3 double, iqr double, lower_fence double,"
    " upper_fence double, mean double, variance double, std_dev double, min double, max double,"
    " n_lower bigint, n_upper bigint, lower_outliers array<double>, upper_outliers array<double>"
)
METADATA = "timestamp string, total_experiments bigint, total_data_points bigint, generated_by string"


def save_results(samples: DataFrame, names: list[str], path: str, metadata: bool = True, statistics: bool = True) -> None:
    """Write samples, per-experiment statistics (null for an empty name) and a metadata record."""
    kept = samples.where(F.col("experiment").isin(*names))
    kept.write.json(f"{path}/raw_results")
    if statistics:
        stats = analyze(kept, names, ["iteration", "rank", "seconds"])
        stats.write.option("ignoreNullFields", False).json(f"{path}/statistical_analysis")
    if metadata:
        points = kept.agg(F.count("seconds").alias("total_data_points"))
        points.select(
            F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
            F.lit(len(names)).cast("bigint").alias("total_experiments"),
            "total_data_points",
            F.lit("tidelog").alias("generated_by"),
        ).write.json(f"{path}/metadata")


def load_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Raw samples and statistics as saved."""
    raw = spark.read.schema(TIMING).option("mode", "FAILFAST").json(f"{path}/raw_results")
    stats = spark.read.schema(STATISTICS).option("mode", "FAILFAST").json(f"{path}/statistical_analysis")
    return raw, stats


def try_load_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """As `load_results`, but None where the dataset is missing or malformed."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException

    try:
        raw, stats = load_results(spark, path)
        raw.write.format("noop").mode("overwrite").save()
        stats.write.format("noop").mode("overwrite").save()
    except (AnalysisException, PySparkException, Py4JJavaError):
        return None
    return raw, stats


def load_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METADATA).json(f"{path}/metadata")


def raw_by_name(samples: DataFrame, names: list[str]) -> DataFrame:
    """Sample counts per saved name, 0 for an empty one."""
    counts = samples.groupBy("experiment").agg(F.count("seconds").alias("n"))
    return name_table(samples, names).join(counts, "experiment", "left").select(
        "experiment", F.coalesce("n", F.lit(0)).alias("n")
    )
