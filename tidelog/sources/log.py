"""Bounded reads of a partitioned message log.

One log layout (the columns of Spark's Kafka source), two back ends: Parquet tables, and Kafka where the
connector is deployed. Ranges are end-inclusive everywhere; Kafka's exclusive end is applied only at its edge.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.session import broadcast_limit, small_table


def kafka_offset_options(topic: str, ranges: dict[int, tuple[int, int]]) -> dict[str, str]:
    """Start and end maps for the Kafka source, from end-inclusive ranges."""
    starts = {topic: {str(p): s for p, (s, _) in ranges.items()}}
    ends = {topic: {str(p): e + 1 for p, (_, e) in ranges.items()}}
    return {"startingOffsets": json.dumps(starts), "endingOffsets": json.dumps(ends)}


def read_kafka_log(
    spark: SparkSession, servers: list[str], topic: str, ranges: dict[int, tuple[int, int]]
) -> DataFrame:
    """Batch read of the given ranges. Needs the Kafka connector on the class path; untested without it."""
    return (
        spark.read.format("kafka")
        .option("kafka.bootstrap.servers", ",".join(servers))
        .option("subscribe", topic)
        .options(**kafka_offset_options(topic, ranges))
        .load()
    )


def read_parquet_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def log_scan(log: DataFrame, schema: T.StructType | str) -> DataFrame:
    """Messages as typed columns; a malformed message keeps its row with null fields."""
    return log.select(F.from_json(F.col("value").cast("string"), schema).alias("parsed")).select("parsed.*")


def range_bounds(rows) -> Column:
    """Literal offset bounds from plan rows, in a form that file sources can push into the scan."""
    spans: dict[int, tuple[int, int]] = {}
    for row in rows:
        if row["start_offset"] > row["end_offset"]:
            continue
        low, high = spans.get(row["partition"], (row["start_offset"], row["end_offset"]))
        spans[row["partition"]] = (min(low, row["start_offset"]), max(high, row["end_offset"]))
    if not spans:
        return F.lit(False)
    # Partitions with equal bounds share a term, so that equal ranges over many partitions stay a short filter.
    alike: dict[tuple[int, int], list[int]] = {}
    for p, span in sorted(spans.items()):
        alike.setdefault(span, []).append(p)
    bounds = [F.col("partition").isin(ps) & F.col("offset").between(s, e) for (s, e), ps in alike.items()]
    # A balanced OR keeps the expression shallow.
    while len(bounds) > 1:
        bounds = [a | b for a, b in zip(bounds[::2], bounds[1::2])] + bounds[len(bounds) // 2 * 2 :]
    return bounds[0]


#: A planned range travels as four numbers.
RANGE_BYTES = 40
#: So many ranges may share a cell with larger ones before they get a cell size of their own.
CELL_RANGES = 64


def cell_levels(ranges: DataFrame) -> list[int]:
    """Powers of two that serve as cell sizes. A range goes to the least that is not shorter than itself; sizes with few ranges are raised to the next."""
    counts = ranges.groupBy("_level").agg(F.count(F.lit(1)).alias("n")).orderBy("_level").collect()  # at most 64
    levels, below = [], 0
    for i, row in enumerate(counts):
        if i + 1 < len(counts) and below + row["n"] <= CELL_RANGES:
            below += row["n"]
        else:
            levels.append(row["_level"])
            below = 0
    return levels


def in_cells(ranges: DataFrame, levels: list[int]) -> DataFrame:
    """One or two cells for each range, of the size that serves its length."""
    size = F.lit(levels[-1])
    for level in reversed(levels[:-1]):
        size = F.when(F.col("_level") <= level, level).otherwise(size)
    sized = ranges.withColumn("_level", size.cast("int"))
    first, last = (F.expr(f"shiftright({c}, _level)") for c in ("start_offset", "end_offset"))
    return sized.withColumn("_cell", F.explode(F.when(first == last, F.array(first)).otherwise(F.array(first, last))))


def interval_join(log: DataFrame, ranges: DataFrame, levels: list[int]) -> DataFrame:
    """Rows of `log` (partition, offset) with every range (partition, start_offset, end_offset) that holds their offset.

    Both sides meet by (partition, cell size, cell), so a message is compared with the ranges near its offset, not with all of its partition, and a
    partition with most of the messages is spread over its cells. A message looks into one cell per size.
    """
    cells = in_cells(ranges, levels)
    one = F.lit(levels[0]) if len(levels) == 1 else F.explode(F.array(*[F.lit(x) for x in levels]))
    probed = log.withColumn("_level", one.cast("int")) if len(levels) == 1 else log.withColumn("_level", one)
    probed = probed.withColumn("_cell", F.expr("shiftright(CAST(offset AS BIGINT), _level)"))
    hit = F.col("offset").between(F.col("start_offset"), F.col("end_offset"))
    return probed.join(cells, ["partition", "_level", "_cell"]).where(hit).drop("_level", "_cell", "start_offset", "end_offset")


def read_ranges(log: DataFrame, plan: DataFrame) -> DataFrame:
    """Every message joined to the split or splits whose range holds its offset.

    A plan whose bytes are below the session's broadcast limit becomes a local relation, which broadcasts on its exact size, with its bounds
    pushed into the scan as literals. A larger one stays where it is. Either way messages and ranges meet in cells of offsets.
    """
    planned = plan.where(F.col("start_offset") <= F.col("end_offset")).select(
        "split_idx", "partition", F.col("start_offset").cast("bigint").alias("start_offset"), F.col("end_offset").cast("bigint").alias("end_offset")
    )
    ranges, rows = small_table(planned, max(1, broadcast_limit(plan.sparkSession) // RANGE_BYTES))
    bounded = log if rows is None else log.where(range_bounds(rows))
    # The least power of two that is not shorter than the range.
    leveled = ranges.withColumn("_level", F.length(F.conv(F.col("end_offset") - F.col("start_offset"), 10, 2)))
    return interval_join(bounded, leveled, cell_levels(leveled) or [1])


def log_offsets(log: DataFrame) -> DataFrame:
    """Offset strings that cover a log, one per partition, numbered by partition."""
    return log.groupBy("partition").agg(F.min("offset").alias("lo"), F.max("offset").alias("hi")).select(
        F.col("partition").cast("bigint").alias("pos"),
        F.concat_ws(":", "partition", "lo", "hi").alias("text"),
    )
