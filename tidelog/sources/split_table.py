"""Pre-split sample tables: Parquet partitioned by split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.schemas import SPLITS


def write_split_table(df: DataFrame, path: str) -> None:
    df.write.partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, split: str, schema=None) -> DataFrame:
    """One split; partition pruning leaves only its directory in the scan."""
    if split not in SPLITS:
        raise ValueError(f"split must be one of {SPLITS}, not {split!r}")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path).where(F.col("split") == split)


def eval_split(use_validation: bool = True) -> str:
    return "val" if use_validation else "test"
