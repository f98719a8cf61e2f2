"""Metric history as a long table, and the reductions and queries over it.

Rows are (phase, epoch, rank, name, value). Reduced tables have one row per (phase, epoch, name); epochs are 1-based.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.lets import idiv, ratio
from tidelog.session import checked_rows, local_table

STEP = ("phase", "epoch", "name")
SERIES = ("phase", "name")
REDUCTIONS = ("mean", "sum", "min", "max")


def scalar(values: Column) -> Column:
    """Mean of an array-valued metric, by which arrays are compared; not-a-number for an empty one."""
    return ratio(F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v.cast("double")), F.size(values))


def reduce_over_workers(df: DataFrame, world_size: int, average: bool = True, keys: tuple[str, ...] = STEP) -> DataFrame:
    """Sum per step and name over workers, divided by the number of workers (not of rows) if averaging."""
    if world_size < 2:
        return df.select(*keys, "value")
    total = F.sum("value")
    return df.groupBy(*keys).agg((total / F.lit(world_size) if average else total).alias("value"))


def aggregate_scalars(
    df: DataFrame, reduction: str, world_size: int, keys: tuple[str, ...] = STEP
) -> DataFrame:
    if reduction not in REDUCTIONS:
        raise ValueError(f"unsupported reduction: {reduction}")
    if world_size < 2:
        return df.select(*keys, "value")
    aggregates = {
        "mean": F.sum("value") / F.lit(world_size),
        "sum": F.sum("value"),
        "min": F.min("value"),
        "max": F.max("value"),
    }
    return df.groupBy(*keys).agg(aggregates[reduction].alias("value"))


def gather(df: DataFrame) -> DataFrame:
    """Per step, every worker's metrics in rank order; a step holds one map per worker."""
    per_rank = df.groupBy("phase", "epoch", "rank").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value")))).alias("metrics")
    )
    # Maps cannot be compared, so the order comes from a windowless sort on the rank alone.
    in_order = F.array_sort(
        F.collect_list(F.struct("rank", "metrics")), lambda a, b: a["rank"] - b["rank"]
    )
    return per_rank.groupBy("phase", "epoch").agg(in_order.alias("workers"))


def append_history(df: DataFrame, path: str) -> None:
    """Append metric rows to the history table."""
    df.write.mode("append").partitionBy("phase").parquet(path)


def latest(df: DataFrame, keys: tuple[str, ...] = SERIES) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by("value", "epoch").alias("latest"))


def history(df: DataFrame, keys: tuple[str, ...] = SERIES, page_epochs: int | None = None) -> DataFrame:
    """Values in epoch order, one row per series. For histories too long for an array, `page_epochs` cuts them into pages."""
    return _paged(df, [*keys], page_epochs).orderBy(*keys, "page")


def _paged(df: DataFrame, keys: list[str], page_epochs: int | None) -> DataFrame:
    page = idiv(F.col("epoch") - 1, page_epochs).cast("int") if page_epochs else F.lit(0)
    values = F.transform(F.sort_array(F.collect_list(F.struct("epoch", "value"))), lambda s: s["value"])
    return df.groupBy(*keys, page.alias("page")).agg(values.alias("values"))


def average_of_last(
    df: DataFrame, wanted: list[tuple[str, str]], last_n: int | None = None
) -> DataFrame:
    """Mean over the whole history or its last n epochs for each wanted (phase, name); 0.0 if there is none."""
    asked = local_table(
        df.sparkSession, [{"phase": p, "name": n} for p, n in wanted], "phase string, name string"
    )
    rows = df.join(asked, ["phase", "name"], "left_semi")
    if last_n is not None:
        newest = Window.partitionBy("phase", "name").orderBy(F.desc("epoch"))
        rows = rows.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= last_n)
    means = rows.groupBy("phase", "name").agg(F.avg("value").alias("average"))
    return asked.join(means, ["phase", "name"], "left").withColumn(
        "average", F.coalesce("average", F.lit(0.0))
    )


def _best(mode: str) -> Column:
    if mode not in ("max", "min"):
        raise ValueError(f"mode must be max or min, not {mode}")
    if mode == "max":
        return F.max(F.struct("value", (-F.col("epoch")).alias("_e")))
    return F.min(F.struct("value", F.col("epoch").alias("_e")))


def best(df: DataFrame, mode: str = "max", keys: tuple[str, ...] = SERIES) -> DataFrame:
    """Best value and its epoch, the first one on ties."""
    return (
        df.groupBy(*keys)
        .agg(_best(mode).alias("_b"))
        .select(*keys, F.col("_b.value").alias("best_value"), F.abs("_b._e").alias("best_epoch"))
    )


def summary(df: DataFrame, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """Latest and best value per series, in one aggregate."""
    return (
        df.groupBy(*keys)
        .agg(F.max_by("value", "epoch").alias("latest"), _best("max").alias("_b"), F.count("value").alias("epochs"))
        .select(
            *keys,
            "latest",
            F.col("_b.value").alias("best_value"),
            F.abs("_b._e").alias("best_epoch"),
            "epochs",
        )
    )


def snapshot(df: DataFrame, epoch_times: DataFrame | None = None, page_epochs: int | None = None) -> DataFrame:
    """The whole history as nested maps phase -> name -> values: one record, or one per page of `page_epochs`.

    With `epoch_times` (one row of totals), its values are added to every record.
    """
    series = _paged(df, ["phase", "name"], page_epochs)
    phases = series.groupBy("page", "phase").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "values")))).alias("names")
    )
    records = phases.groupBy("page").agg(
        F.map_from_entries(F.collect_list(F.struct("phase", "names"))).alias("metrics_history")
    )
    # A one-row aggregate of its own: the histories themselves never meet in one task for it.
    records = records.withColumn("current_epoch", df.agg(F.max("epoch")).scalar())
    if epoch_times is not None:
        rows = checked_rows(epoch_times, 1)
        if not rows:
            raise ValueError("epoch times must be one row of totals")
        for name in epoch_times.columns:
            records = records.withColumn(name, F.lit(rows[0][name]))
    return records


def curves(df: DataFrame, batch_sizes: list[int]) -> DataFrame:
    """Train and validation accuracy and loss per epoch, one column per batch size, null where a series is missing."""
    kept = df.where(F.col("phase").isin("train", "val") & F.col("name").isin("accuracy", "loss"))
    columns = [
        F.first(F.when(F.col("batch_size") == b, F.col("value")), ignorenulls=True).alias(f"bs_{b}")
        for b in batch_sizes
    ]
    return kept.where(F.col("batch_size").isin(*batch_sizes)).groupBy("phase", "name", "epoch").agg(*columns)
