"""Keyed checkpoint log: an append-only table of (unique_key, epoch, saved_at, offset, params, extra).

Parameters are by far the widest column, so every lookup first finds its winner among the narrow key columns and then
joins back for that row only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IDENTITY = ["unique_key", "saved_at", "offset"]


def save(df: DataFrame, path: str) -> None:
    """Append checkpoints to the log."""
    df.write.mode("append").parquet(path)


def latest_per_key(log: DataFrame) -> DataFrame:
    """What is left when a later save under the same key overwrites the earlier one."""
    newest = (
        log.groupBy("unique_key")
        .agg(F.max(F.struct("saved_at", "offset")).alias("_m"))
        .select("unique_key", "_m.saved_at", "_m.offset")
    )
    return log.join(newest, IDENTITY, "left_semi")


def name_stamp(name: Column) -> Column:
    """The last two `_` pieces of a name, before the first dot: keys are expected to end in a timestamp."""
    return F.substring_index(F.substring_index(name, "_", -2), ".", 1)


def _one(log: DataFrame, winner: DataFrame) -> DataFrame:
    """The full rows of a one-row winner; its bound is one row, so it broadcasts."""
    return log.join(F.broadcast(winner), IDENTITY, "left_semi")


def load_latest(log: DataFrame, key_part: str | None = None, by: str = "name") -> DataFrame:
    """Newest checkpoint whose key contains `key_part`, or of all; no row if none matches.

    `name` compares the keys' trailing stamps as text, `time` compares the save times.
    """
    found = log if not key_part else log.where(F.contains("unique_key", F.lit(key_part)))
    if by == "name":
        order = F.struct(name_stamp(F.col("unique_key")), "saved_at", "offset")
    elif by == "time":
        order = F.struct("saved_at", "offset", "unique_key")
    else:
        raise ValueError(f"order must be name or time, not {by}")
    winner = found.agg(F.max_by(F.struct(*IDENTITY), order).alias("_w")).select("_w.*")
    return _one(log, winner.where(F.col("unique_key").isNotNull()))


def load_first(log: DataFrame, unique_key: str) -> DataFrame:
    """The earliest record of exactly this key."""
    if not unique_key:
        raise ValueError("a key is needed to search the checkpoint log")
    winner = (
        log.where(F.col("unique_key") == unique_key)
        .agg(F.min_by(F.struct(*IDENTITY), F.struct("offset", "saved_at")).alias("_w"))
        .select("_w.*")
    )
    return _one(log, winner.where(F.col("unique_key").isNotNull()))


def list_checkpoints(log: DataFrame) -> DataFrame:
    """Keys and epochs, newest first."""
    return log.select("unique_key", "epoch", "saved_at", "offset").orderBy(
        F.desc("saved_at"), F.desc("offset")
    )


def retain_newest(log: DataFrame, keep: int = 5) -> DataFrame:
    """The newest `keep` checkpoints; the top rows are found per task on key columns before anything is gathered."""
    newest = log.select(*IDENTITY).orderBy(F.desc("saved_at"), F.desc("offset")).limit(keep)
    return log.join(newest, IDENTITY, "left_semi")


def count_removed(log: DataFrame, keep: int = 5) -> DataFrame:
    return log.agg(F.greatest(F.count(F.lit(1)) - keep, F.lit(0)).alias("removed"))


def write_retained(log: DataFrame, path: str, keep: int = 5) -> int:
    """Write a new snapshot of the newest `keep` checkpoints and return how many were left out."""
    retain_newest(log, keep).write.parquet(path)
    return count_removed(log, keep).first()["removed"]


def describe(log: DataFrame) -> DataFrame:
    """Record fields, key, epoch, save time, parameter names and total parameter count of each checkpoint."""
    fields = F.array(F.lit("model"), F.lit("unique_key"), F.lit("epoch"))
    if "extra" in log.columns:
        fields = F.concat(fields, F.coalesce(F.array_sort(F.map_keys("extra")), F.array().cast("array<string>")))
    total = F.aggregate(F.map_values("params"), F.lit(0).cast("bigint"), lambda acc, p: acc + F.size(p))
    return log.select(
        "unique_key",
        "epoch",
        "saved_at",
        "offset",
        fields.alias("keys"),
        F.array_sort(F.map_keys("params")).alias("param_names"),
        total.alias("model_parameters"),
        (total * 4).alias("param_bytes"),
    )
