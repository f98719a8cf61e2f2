"""Timer events to durations, profiles, and recorded load experiments."""

from __future__ import annotations

import time
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.lets import idiv, ratio
from tidelog.operators.assemble import LOADERS, per_worker_batch, role_of
from tidelog.operators.ordered import with_previous_scan
from tidelog.operators.quantiles import exact_quantiles, range_columns
from tidelog.operators.stats import name_table
from tidelog.plans.splits import normalize_splits
from tidelog.schemas import Payload
from tidelog.session import checked_rows, local_table, small_table
from tidelog.sources.decode import decode
from tidelog.sources.log import read_ranges


def _with_previous_event(events: DataFrame) -> DataFrame:
    return with_previous_scan(events, ["name"], ["ts_us", "seq"], ["kind", "ts_us"])


def pair_timers(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Completed timers and unmatched ends from columns name, kind (start or end), ts_us, seq.

    An end closes the timer only if the event before it under the same name is a start, so a second start overwrites the
    first and a second end is unmatched. A name with most of the events, even inside one moment, is spread over many tasks.
    """
    ends = _with_previous_event(events.select("name", "kind", "ts_us", "seq")).where(F.col("kind") == "end")
    opened = F.coalesce(F.col("prev.kind") == "start", F.lit(False))
    pairs = ends.where(opened).select(
        "name",
        "seq",
        F.col("prev.ts_us").alias("start_us"),
        F.col("ts_us").alias("end_us"),
        (F.col("ts_us") - F.col("prev.ts_us")).alias("duration_us"),
    )
    return pairs, ends.where(~opened).select("name", "seq", "ts_us")


def _seconds(micros: Column) -> Column:
    return micros / F.lit(1e6)


def timer_profile(pairs: DataFrame) -> DataFrame:
    d = F.col("duration_us")
    return pairs.groupBy("name").agg(
        F.count(d).alias("count"),
        _seconds(F.sum(d)).alias("total"),
        _seconds(F.avg(d)).alias("avg"),
        _seconds(F.min(d)).alias("min"),
        _seconds(F.max(d)).alias("max"),
    )


def timer_lookup(pairs: DataFrame, names: list) -> DataFrame:
    """Average and total of the asked timers; 0.0 for one that never completed."""
    dtype = pairs.schema["name"].dataType.simpleString()
    asked = local_table(pairs.sparkSession, [{"name": n} for n in names], f"name {dtype}")
    found = timer_profile(pairs.where(F.col("name").isin(*names))).select("name", "avg", "total")
    return asked.join(found, "name", "left").select(
        "name",
        F.coalesce("avg", F.lit(0.0)).alias("average_time"),
        F.coalesce("total", F.lit(0.0)).alias("total_time"),
    )


def epoch_times(events: DataFrame) -> DataFrame:
    """Per run: epochs started and completed, total and average epoch time. Unmatched ends are ignored."""
    ordered = _with_previous_event(events.select("name", "kind", "ts_us", "seq"))
    done = (F.col("kind") == "end") & F.coalesce(F.col("prev.kind") == "start", F.lit(False))
    took = F.when(done, F.col("ts_us") - F.col("prev.ts_us"))
    return ordered.groupBy("name").agg(
        F.count_if(F.col("kind") == "start").alias("current_epoch"),
        F.count(took).alias("epochs_completed"),
        _seconds(F.coalesce(F.sum(took), F.lit(0))).alias("total_epoch_time"),
        _seconds(F.avg(took)).alias("average_epoch_time"),
    )


def batch_timing(df: DataFrame, names: list[str], max_batches: int | None = None) -> DataFrame:
    """Batch-time statistics per named experiment from columns experiment, batch_id (0-based), seconds.

    0 or None takes all batches; an experiment without batches gives zeros.
    """
    kept = df.where(F.col("experiment").isin(*names))
    if max_batches:
        kept = kept.where(F.col("batch_id") < max_batches)
    v = F.col("seconds")
    base = kept.groupBy("experiment").agg(*range_columns(v), F.sum(v).alias("total"), F.avg(v).alias("mean"))
    base, _ = small_table(base.where("_n > 0"))
    medians = exact_quantiles(kept, "experiment", "seconds", [0.5], base)
    stats = base.join(medians, "experiment")
    zero = F.lit(0.0)
    return (
        name_table(df, names)
        .join(stats, "experiment", "left")
        .select(
            "experiment",
            F.coalesce("total", zero).alias("total_time"),
            F.coalesce("mean", zero).alias("mean_batch_time"),
            F.coalesce(F.col("q")[0], zero).alias("median_batch_time"),
            F.coalesce("_min", zero).alias("min_batch_time"),
            F.coalesce("_max", zero).alias("max_batch_time"),
            F.coalesce("_n", F.lit(0)).alias("num_batches"),
            ratio(F.col("_n"), F.col("total")).alias("batches_per_second"),
        )
    )


def load_summary(samples: DataFrame) -> DataFrame:
    """Average, min and max over ranks of each experiment's load times."""
    return samples.groupBy("experiment").agg(
        F.count("seconds").alias("ranks"),
        F.avg("seconds").alias("avg_load_time"),
        F.min("seconds").alias("min_load_time"),
        F.max("seconds").alias("max_load_time"),
    )


@dataclass(frozen=True)
class LoadConfig:
    """One experiment: a log, its split plan and its payload."""

    name: str
    log: DataFrame
    plan: DataFrame
    payload: Payload


def measure_load(samples: DataFrame) -> DataFrame:
    """Read everything; one row per (split, rank) of row count and the wall time from first to last row.

    Tasks report what they saw and the spans are merged, so a rank's range may be read by many tasks.
    """
    schema = "split_idx int, rank int, n_rows bigint, started double, ended double"

    def observe(batches):
        began = time.time()
        seen: dict[tuple[int, int], int] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch]).group_by(["split_idx", "rank"]).aggregate([([], "count_all")])
            for row in table.to_pylist():
                cell = (row["split_idx"], row["rank"])
                seen[cell] = seen.get(cell, 0) + row["count_all"]
        ended = time.time()
        for (split_idx, rank), n in seen.items():
            yield pa.RecordBatch.from_pylist(
                [{"split_idx": split_idx, "rank": rank, "n_rows": n, "started": began, "ended": ended}],
                schema=pa.schema(
                    [
                        ("split_idx", pa.int32()),
                        ("rank", pa.int32()),
                        ("n_rows", pa.int64()),
                        ("started", pa.float64()),
                        ("ended", pa.float64()),
                    ]
                ),
            )

    return (
        samples.mapInArrow(observe, schema)
        .groupBy("split_idx", "rank")
        .agg(F.sum("n_rows").alias("n_rows"), F.min("started").alias("started"), F.max("ended").alias("ended"))
    )


def run_load_experiment(
    configs: list[LoadConfig], splits, batch_size: int, world_size: int, iterations: int = 1
) -> tuple[DataFrame, DataFrame]:
    """Load each configuration `iterations` times; returns timing samples and batch counts.

    Configurations run one after another so that they do not share executors. What comes back per run is
    splits x ranks rows, with its size checked.
    """
    if not configs:
        raise ValueError("no experiment configurations")
    spark = configs[0].log.sparkSession
    n_splits = len(normalize_splits(splits))
    timings: list[dict] = []
    batches: list[dict] = []
    for iteration in range(iterations):
        for config in configs:
            decoded = decode(read_ranges(config.log, config.plan), config.payload)
            # `x` and `y` go through the measurement so that decoding is not pruned away.
            rows = checked_rows(
                measure_load(
                    decoded.where(~F.col("is_bad")).select(
                        "split_idx", F.col("partition").alias("rank"), "x", "y"
                    )
                )
            )
            if rows is None:
                raise ValueError("a load run reports one row per split and rank; there are too many ranks")
            for rank in sorted({r["rank"] for r in rows}):
                spans = [r for r in rows if r["rank"] == rank]
                took = max(r["ended"] for r in spans) - min(r["started"] for r in spans)
                timings.append(
                    {"experiment": config.name, "iteration": iteration, "rank": rank, "seconds": took}
                )
            if iteration == 0:
                batches += [
                    {"experiment": config.name, "rank": r["rank"], "split_idx": r["split_idx"], "n_rows": r["n_rows"]}
                    for r in rows
                ]
    timing = local_table(spark, timings, "experiment string, iteration int, rank int, seconds double")
    counts = local_table(spark, batches, "experiment string, rank int, split_idx int, n_rows bigint")
    counts = counts.withColumn("role", role_of(F.col("split_idx"), n_splits)).withColumn(
        "n_batches", F.ceil(F.col("n_rows") / per_worker_batch(batch_size, world_size)).cast("bigint")
    )
    return timing, counts


def batches_by_role(counts: DataFrame) -> DataFrame:
    """Batch counts per experiment and rank, one column per role, 0 where there is no loader."""
    return counts.groupBy("experiment", "rank").agg(
        *[
            F.coalesce(F.sum(F.when(F.col("role") == r, F.col("n_batches"))), F.lit(0)).alias(f"{r}_batches")
            for r in LOADERS
        ]
    )
