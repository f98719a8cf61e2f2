"""Messages to workers: placement by rank and the bootstrap fill-up of the last split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.ordered import chunk_bucket, digest, with_position
from tidelog.plans.splits import normalize_splits
from tidelog.session import small_table

# Rows emitted per array when a count is expanded into rows.
EXPAND_CHUNK = 65_536


def assign_rank(df: DataFrame) -> DataFrame:
    """Worker r owns log partition r."""
    return df.withColumn("rank", F.col("partition"))


def place_by_rank(df: DataFrame, world_size: int) -> DataFrame:
    """Physically put each rank's rows in the task of the same number. Only for work that needs the placement."""
    return df.repartitionById(world_size, F.col("rank"))


def draw_index(seed: int, partition: Column, i: Column, n: Column) -> Column:
    """Repeatable uniform draw in [0, n) from 60 bits of md5."""
    bits = F.conv(F.substring(digest(seed, partition, i), 1, 15), 16, 10).cast("bigint")
    return bits % n


def expand(df: DataFrame, first: Column, last: Column, name: str, spread: bool = False) -> DataFrame:
    """One row per integer in [first, last]; long spans are cut into chunks, and spread over tasks if asked."""
    chunk = F.lit(EXPAND_CHUNK)
    chunks = df.withColumn("_lo", first).withColumn("_hi", last).where("_lo <= _hi").withColumn(
        "_at", F.explode(F.sequence("_lo", "_hi", chunk.cast("bigint")))
    )
    if spread:
        # A stated number of partitions: adaptive execution would merge these few small rows into one task.
        tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        chunks = chunks.repartition(tasks, *df.columns, "_at")
    return chunks.withColumn(
        name, F.explode(F.sequence("_at", F.least("_hi", F.col("_at") + chunk - 1)))
    ).drop("_lo", "_hi", "_at")


def bootstrap_fillup(samples: DataFrame, plan: DataFrame, splits, seed: int = 0) -> DataFrame:
    """Top up the last split so that every partition holds as many rows as its widest range.

    Missing rows are drawn with replacement from the partition's own rows. Draws are spread over tasks and counted per
    drawn row before the join, so a row drawn many times is one join row. `copy` is 0 for the original.
    """
    config = normalize_splits(splits)
    last = len(config) - 1
    if not config[last].fillup:
        return samples.withColumn("copy", F.lit(0).cast("bigint"))
    own = samples.where(F.col("split_idx") == last)
    sizes = own.groupBy("partition").agg(F.count(F.lit(1)).alias("n"))
    ranges = plan.where(F.col("split_idx") == last)
    width = F.col("end_offset") - F.col("start_offset")
    missing = (
        ranges.select("partition", (F.max(width).over(Window.partitionBy("split_idx")) + 1).alias("target"))
        .join(sizes, "partition", "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn("deficit", F.col("target") - F.col("n"))
        .where("deficit > 0")
        .select("partition", "n", "deficit")
    )
    # At most one row per log partition.
    missing, rows = small_table(missing)
    empty = [r["partition"] for r in rows or [] if r["n"] == 0]
    if empty:
        raise ValueError(f"no rows to draw from in partitions {empty}")
    if rows == []:
        return samples.withColumn("copy", F.lit(0).cast("bigint"))
    # The same error for a plan too large to look at here.
    none = F.raise_error(F.concat(F.lit("no rows to draw from in partitions ["), F.col("partition").cast("string"), F.lit("]")))
    missing = missing.withColumn("n", F.when(F.col("n") > 0, F.col("n")).otherwise(none.cast("bigint")))
    draws = expand(missing, F.lit(1).cast("bigint"), F.col("deficit"), "i", spread=True)
    extra = (
        draws.withColumn("_index", draw_index(seed, F.col("partition"), F.col("i"), F.col("n")))
        .groupBy("partition", "_index")
        .agg(F.count(F.lit(1)).alias("_extra"))
    )
    numbered = with_position(own, ["partition"], ["offset"], chunk_bucket("offset"), "_index", "_n")
    repeated = numbered.join(extra, ["partition", "_index"], "left").withColumn(
        "_extra", F.coalesce("_extra", F.lit(0).cast("bigint"))
    )
    filled = expand(repeated, F.lit(0).cast("bigint"), F.col("_extra"), "copy").drop("_index", "_n", "_extra")
    rest = samples.where(F.col("split_idx") < last).withColumn("copy", F.lit(0).cast("bigint"))
    return rest.unionByName(filled)
