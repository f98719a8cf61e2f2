"""Samples to epochs: roles, order, shards, batches, and what loaders report about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.lets import idiv
from tidelog.operators.ordered import chunk_bucket, digest, hash_bucket, with_position
from tidelog.session import local_table

# The sampler's default seed, and the role names by number of splits.
SAMPLER_SEED = 42
ROLES = {1: ("train",), 2: ("train", "test"), 3: ("train", "val", "test")}
LOADERS = ("train", "val", "test")


def _ceil_div(a: Column, b: Column) -> Column:
    return idiv(a + b - 1, b)


def role_of(split_idx: Column, n_splits: int) -> Column:
    """Role of a split by its number and how many there are."""
    if n_splits not in ROLES:
        raise ValueError(f"1 to 3 splits have roles, not {n_splits}")
    return F.element_at(F.array(*[F.lit(r) for r in ROLES[n_splits]]), split_idx + 1)


def per_worker_batch(batch_size: int, world_size: int) -> int:
    return max(1, int(batch_size / world_size))


def shuffle_key(key: str, seed: int, epoch: int = 0) -> Column:
    return digest(seed, epoch, F.col(key))


def shuffled_positions(df: DataFrame, key: str, seed: int, epoch: int = 0, keys: tuple[str, ...] = ()) -> DataFrame:
    """Add `pos`, a repeatable uniform random order; a new epoch gives a new order."""
    hashed = shuffle_key(key, seed, epoch)
    return with_position(df, list(keys), [hashed, key], hash_bucket(hashed))


def role_positions(
    df: DataFrame, key: str, seed: int = SAMPLER_SEED, epoch: int = 0, keys: tuple[str, ...] = ("role",)
) -> DataFrame:
    """Add `pos` per role: train in random order, the others in one fixed order that no seed or epoch changes.

    A table has no row order of its own, so the fixed order is the digest of the row key. It buckets evenly
    however the keys are distributed. Logs have offsets: see `log_positions`.
    """
    hashed = F.when(F.col("role") == "train", shuffle_key(key, seed, epoch)).otherwise(digest(F.col(key)))
    return with_position(df, list(keys), [hashed, key], hash_bucket(hashed))


def log_positions(df: DataFrame, seed: int = SAMPLER_SEED, epoch: int = 0) -> DataFrame:
    """Add `pos` per role and rank of log samples: train in random order, the others in offset order."""
    train = F.col("role") == "train"
    copy = F.col("copy") if "copy" in df.columns else F.lit(0)
    hashed = F.when(train, digest(seed, epoch, F.col("partition"), F.col("offset"), copy))
    # Copies from the fill-up follow the originals, as they are appended to them.
    bucket = F.when(train, hash_bucket(hashed)).otherwise(
        F.concat_ws(
            ":",
            F.lpad(copy.cast("string"), 19, "0"),
            F.lpad(chunk_bucket("offset").cast("string"), 19, "0"),
        )
    )
    return with_position(df, ["role", "rank"], [hashed, copy, "offset"], bucket)


def shard(df: DataFrame, world_size: int, drop_last: Column) -> DataFrame:
    """Deal positions to `world_size` shards of equal length.

    With `drop_last` the tail that does not divide evenly is left out; otherwise the first rows are dealt again until it
    does. Repeats come from the row itself, without a second pass over the table. Adds `slot`, `shard`, `shard_pos`
    and `shard_size`.
    """
    w = F.lit(world_size)
    n = F.col("n_total")
    size = F.when(drop_last, idiv(n, w)).otherwise(_ceil_div(n, w))
    dealt = df.withColumn("shard_size", size).where(F.col("pos") < F.col("shard_size") * w)
    slots = F.sequence("pos", F.col("shard_size") * w - 1, n)
    return (
        dealt.withColumn("slot", F.explode(slots))
        .withColumn("shard", (F.col("slot") % w).cast("int"))
        .withColumn("shard_pos", idiv("slot", w))
    )


def batch(
    df: DataFrame, batch_size: int, pos: str = "shard_pos", size: str = "shard_size", drop_last: bool = False
) -> DataFrame:
    """Add `batch_id` and `batch_pos`: consecutive groups along `pos`, the last one kept or dropped."""
    b = F.lit(batch_size)
    grouped = df.withColumn("batch_id", idiv(pos, b)).withColumn(
        "batch_pos", (F.col(pos) % b).cast("int")
    )
    return grouped.where(F.col("batch_id") < idiv(size, b)) if drop_last else grouped


def batch_arrays(batched: DataFrame, columns: list[str], keys: tuple[str, ...] = ("role", "shard")) -> DataFrame:
    """One row per batch with its samples in order; a group is at most one batch."""
    rows = F.sort_array(F.collect_list(F.struct("batch_pos", *columns)))
    return batched.groupBy(*keys, "batch_id").agg(rows.alias("samples"))


def epoch_table(
    df: DataFrame,
    key: str,
    batch_size: int,
    world_size: int | None = None,
    seed: int = SAMPLER_SEED,
    epoch: int = 0,
    drop_last: bool = True,
) -> DataFrame:
    """Train, val and test loaders of one epoch as one table.

    Sharded: train is shuffled and its uneven tail dropped by the sampler, the others keep their order and are padded.
    `drop_last` is the loader's own flag: whether train drops its last partial batch too. The loaders that training uses
    do; sharded loaders without it exist as well. Unsharded: one shard, and train always drops its partial batch.
    """
    placed = role_positions(df, key, seed, epoch)
    is_train = F.col("role") == "train"
    dealt = shard(placed, world_size or 1, drop_last=is_train if world_size is not None else F.lit(False))
    batched = batch(dealt, batch_size)
    if world_size is not None and not drop_last:
        return batched
    return batched.where(~is_train | (F.col("batch_id") < idiv("shard_size", batch_size)))


def loader_stats(
    df: DataFrame, batch_size: int, world_size: int | None = None, roles: tuple[str, ...] = LOADERS, drop_last: bool = True
) -> DataFrame:
    """Per role: dataset size, batch size, batches per worker, samples per epoch, drop_last; nulls for no loader.

    `drop_last` is the train loader's flag, as in `epoch_table`.
    """
    counts = df.groupBy("role").agg(F.count(F.lit(1)).alias("dataset_size"))
    n, b = F.col("dataset_size"), F.lit(batch_size)
    is_train = F.col("role") == "train"
    drops = is_train if drop_last or world_size is None else F.lit(False)
    w = F.lit(world_size or 1)
    per_worker = F.when(is_train, idiv(n, w)).otherwise(_ceil_div(n, w))
    batches = F.when(drops, idiv(per_worker, b)).otherwise(_ceil_div(per_worker, b))
    names = local_table(df.sparkSession, [{"role": r} for r in roles], "role string")
    present = counts.select(
        "role",
        "dataset_size",
        b.alias("batch_size"),
        batches.alias("num_batches"),
        (batches * b).alias("total_samples_per_epoch"),
        drops.alias("drop_last"),
    )
    return names.join(present, "role", "left")


def batch_info(df: DataFrame, batch_size: int, world_size: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Batches per rank and role, 0 where a rank has no loader for it."""
    counts = df.groupBy(*by, "rank", "role").agg(F.count(F.lit(1)).alias("n"))
    batches = _ceil_div(F.col("n"), F.lit(per_worker_batch(batch_size, world_size)))
    return (
        counts.withColumn("batches", batches)
        .groupBy(*by, "rank")
        .agg(
            *[
                F.coalesce(F.max(F.when(F.col("role") == r, F.col("batches"))), F.lit(0)).alias(f"{r}_batches")
                for r in LOADERS
            ]
        )
    )


def first_batch_profile(batched: DataFrame, data: str, label: str, keys: tuple[str, ...] = ("role", "shard")) -> DataFrame:
    """Size, shape, value range and labels of each loader's first batch, with the dataset's size."""
    return (
        batched.where(F.col("batch_id") == 0)
        .groupBy(*keys)
        .agg(
            F.max("n_total").alias("dataset_size"),
            F.count(F.lit(1)).alias("batch_rows"),
            F.max(F.size(data)).alias("data_width"),
            F.min(F.array_min(data)).alias("data_min"),
            F.max(F.array_max(data)).alias("data_max"),
            F.sort_array(F.collect_set(label)).alias("labels"),
        )
        .withColumn("data_type", F.lit(batched.schema[data].dataType.elementType.simpleString()))
        .withColumn("label_type", F.lit(batched.schema[label].dataType.simpleString()))
    )


def sample_at(positioned: DataFrame, index: int) -> DataFrame:
    return positioned.where(F.col("pos") == index)
