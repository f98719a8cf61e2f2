"""Split plans: offset ranges per partition for train, validation and test.

Ranges are end-inclusive. The plan is one declarative expression over (offsets x splits): widths
per split, a running sum of them per partition, and clamping to the partition's end.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.session import local_table


@dataclass(frozen=True)
class Split:
    rate: float | None = None
    fillup: bool | None = None


def normalize_splits(splits) -> list[Split]:
    """Fill defaults and check rates; accepts Split objects or dicts and leaves the input alone."""
    given = [s if isinstance(s, Split) else Split(s.get("rate"), s.get("fillup")) for s in splits or []]
    if not given:
        return [Split(1.0, True)]
    rates = [s.rate for s in given]
    fillups = [s.fillup is None or s.fillup for s in given]
    if None in rates[:-1]:
        raise ValueError(f"split {rates.index(None)} has no rate; only the last split may omit it")
    if rates[-1] is None:
        rates[-1] = round(1.0 - sum(rates[:-1]), 10)
    sums = list(accumulate(rates))
    beyond = [i for i, total in enumerate(sums[:-1]) if total > 1.0]
    if beyond:
        raise ValueError(f"split rates exceed 1.0 after entry {beyond[0]}")
    rest = round(1.0 - sums[-1], 10)
    if rest > 0:
        rates, fillups = [*rates, rest], [*fillups, True]
    final = round(sum(rates), 10)
    if final != 1.0:
        raise ValueError(f"split rates sum to {final}, not 1.0")
    return [Split(r, f) for r, f in zip(rates, fillups, strict=True)]


def offset_strings(spark: SparkSession, texts: list[str]) -> DataFrame:
    """Offset strings given inline, numbered in input order."""
    return local_table(
        spark, [{"pos": i, "text": t} for i, t in enumerate(texts)], "pos bigint, text string"
    )


def _parsed(strings: DataFrame) -> DataFrame:
    parts = F.split("text", ":")

    def number(i: int, dtype: str) -> Column:
        return F.get(parts, F.lit(i)).try_cast(dtype)

    return strings.select(
        "pos",
        "text",
        F.size(parts).alias("n_parts"),
        number(0, "int").alias("partition"),
        number(1, "bigint").alias("start_offset"),
        number(2, "bigint").alias("end_offset"),
    )


def _well_formed() -> Column:
    return (
        (F.col("n_parts") == 3)
        & F.col("partition").isNotNull()
        & F.col("start_offset").isNotNull()
        & F.col("end_offset").isNotNull()
    )


def parse_offsets(strings: DataFrame, strict: bool = False) -> DataFrame:
    """`partition:start:end` texts to numbers, with diff = end - start - 1.

    Strict mode fails on the first malformed text; otherwise see `malformed_offsets`.
    """
    parsed = _parsed(strings)
    if strict:
        checked = F.when(_well_formed(), F.col("partition")).otherwise(
            F.raise_error(F.concat(F.lit("malformed offset string: "), F.col("text"))).cast("int")
        )
        parsed = parsed.withColumn("partition", checked)
    else:
        parsed = parsed.where(_well_formed())
    return parsed.select(
        "pos",
        "partition",
        "start_offset",
        "end_offset",
        (F.col("end_offset") - F.col("start_offset") - 1).alias("diff"),
    )


def malformed_offsets(strings: DataFrame) -> DataFrame:
    return _parsed(strings).where(~_well_formed()).select("pos", "text")


def split_width(diff: Column, rate: Column) -> Column:
    """max(1, diff * rate) rounded half to even."""
    return F.greatest(F.lit(1), F.rint(diff * rate).cast("bigint"))


def plan_splits(offsets: DataFrame, splits, mode: str = "compat") -> DataFrame:
    """Offset ranges per split and partition.

    `compat` clamps an exhausted partition to its end, so that one offset may fall in two splits;
    `disjoint` marks such ranges empty instead.
    """
    if mode not in ("compat", "disjoint"):
        raise ValueError(f"unknown plan mode: {mode}")
    config = normalize_splits(splits)
    last = len(config) - 1
    entries = F.array(
        *[
            F.struct(F.lit(i).alias("split_idx"), F.lit(s.rate).alias("rate"), F.lit(s.fillup).alias("fillup"))
            for i, s in enumerate(config)
        ]
    )
    own = split_width(F.col("diff"), F.col("rate"))
    grid = offsets.select("partition", "start_offset", "end_offset", "diff", F.inline(entries))
    widths = grid.withColumn("own_width", own).withColumn(
        "width",
        F.when(F.col("fillup"), F.max("own_width").over(Window.partitionBy("split_idx"))).otherwise(
            F.col("own_width")
        ),
    )
    earlier = (
        Window.partitionBy("partition")
        .orderBy("split_idx")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    wanted = F.col("start_offset") + F.coalesce(F.sum(F.col("width") + 1).over(earlier), F.lit(0))
    end = F.col("end_offset")
    if mode == "compat":
        first = F.when(F.col("split_idx") == 0, F.col("start_offset")).otherwise(F.least("_wanted", end))
    else:
        first = F.least("_wanted", end + 1)
    ranged = (
        widths.withColumn("_wanted", wanted)
        .withColumn("_first", first)
        .withColumn("_last", F.when(F.col("split_idx") == last, end).otherwise(F.least(F.col("_first") + F.col("width"), end)))
    )
    return ranged.select(
        "split_idx",
        "partition",
        F.col("_first").alias("start_offset"),
        F.col("_last").alias("end_offset"),
        (F.col("_last") - F.col("_first") + 1).alias("n_messages"),
        (F.col("_first") > F.col("_last")).alias("is_empty"),
    )


def offset_distribution(offsets: DataFrame, world_size: int) -> DataFrame:
    """One row of totals; record counts here are end - start, as the estimate defines them."""
    size = F.col("diff") + 1
    total = F.sum(size)
    return offsets.agg(
        total.alias("total_records"),
        F.avg(size).alias("avg_records_per_partition"),
        (total / F.lit(world_size)).alias("avg_records_per_process"),
        F.min(size).alias("min_partition_size"),
        F.max(size).alias("max_partition_size"),
        F.transform(
            F.sort_array(F.collect_list(F.struct("pos", size.alias("size")))), lambda s: s["size"]
        ).alias("partition_sizes"),
    )


def partition_worker_check(log: DataFrame, strings: DataFrame, world_size: int, strict: bool = False) -> DataFrame:
    """One-row verdict: log partitions and offset strings both number `world_size`. Strict mode fails where they do not."""
    found = log.agg(F.countDistinct("partition").alias("n_partitions"))
    given = strings.agg(F.count(F.lit(1)).alias("n_offset_strings"))
    both = found.unionByName(given, allowMissingColumns=True)
    verdict = both.agg(
        F.max("n_partitions").alias("n_partitions"), F.max("n_offset_strings").alias("n_offset_strings")
    ).select(
        "n_partitions",
        "n_offset_strings",
        F.lit(world_size).alias("world_size"),
        (F.col("n_partitions") == world_size).alias("partitions_match"),
        (F.col("n_offset_strings") == world_size).alias("strings_match"),
    )
    if not strict:
        return verdict
    counts = F.format_string("%d partitions and %d offset strings for %d workers", "n_partitions", "n_offset_strings", "world_size")
    fine = F.col("partitions_match") & F.col("strings_match")
    return verdict.withColumn("partitions_match", F.when(fine, F.lit(True)).otherwise(F.raise_error(counts).cast("boolean")))


def split_report(plan: DataFrame) -> DataFrame:
    return plan.orderBy("split_idx", "partition")
