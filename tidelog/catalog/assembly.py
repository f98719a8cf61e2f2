"""Queries over samples: splits, order, shards, batches, loaders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.catalog import views as v
from tidelog.catalog.logs import JSON
from tidelog.catalog.registry import query
from tidelog.catalog.views import WORLD, plan_sql, with_views
from tidelog.operators import assemble as asm
from tidelog.operators.assign import assign_rank
from tidelog.session import scratch_path
from tidelog.sources.decode import decode
from tidelog.sources.log import read_ranges
from tidelog.sources.split_table import eval_split, read_split, write_split_table

BATCH = 64
X4 = [f"x{i}" for i in range(4)]


def flat_x(df, *more):
    return df.select(*more, *[F.get("x", F.lit(i)).alias(c) for i, c in enumerate(X4)])


@query(
    "split_scan",
    with_views("SELECT sample_key, y, x0, x1, x2, x3 FROM sample_split WHERE role = 'val'", "sample_split"),
)
def split_scan(spark, sf_dir):
    path = scratch_path(spark, "split-table")
    write_split_table(v.sample_split(spark, sf_dir), path)
    return flat_x(read_split(spark, path, "val"), "sample_key", "y")


@query(
    "eval_split_choice",
    with_views(
        """SELECT role = 'val' AS use_validation, role AS split, count(*) AS n FROM sample_split
           WHERE role IN ('val', 'test') GROUP BY ALL""",
        "sample_split",
    ),
)
def eval_choice(spark, sf_dir):
    samples = v.sample_split(spark, sf_dir)
    choice = F.when(F.col("split") == eval_split(True), True).when(F.col("split") == eval_split(False), False)
    return (
        samples.withColumn("use_validation", choice)
        .where(F.col("use_validation").isNotNull())
        .groupBy("use_validation", "split")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "shuffle_order",
    with_views(
        """SELECT sample_key, epoch, row_number() OVER (PARTITION BY epoch ORDER BY md5('7:' || epoch || ':' || sample_key), sample_key) - 1 AS pos
           FROM sample_split, (VALUES (0), (1)) AS e(epoch) WHERE role = 'train'""",
        "sample_split",
    ),
)
def shuffle_order(spark, sf_dir):
    train = v.role_samples(spark, sf_dir).where(F.col("role") == "train").select("sample_key")
    epochs = [
        asm.shuffled_positions(train, "sample_key", seed=7, epoch=e).select("sample_key", F.lit(e).alias("epoch"), "pos")
        for e in (0, 1)
    ]
    return epochs[0].unionByName(epochs[1])


def _shards(spark, sf_dir):
    placed = asm.role_positions(v.role_samples(spark, sf_dir), "sample_key")
    return asm.shard(placed, WORLD, drop_last=F.col("role") == "train")


SHARD_SQL = "SELECT role, sample_key, pos, CAST(shard AS INTEGER) AS shard, shard_pos FROM shard_slots WHERE role {}"


@query("shard_train", with_views(SHARD_SQL.format("= 'train'"), "shard_slots"))
def shard_train(spark, sf_dir):
    return _shards(spark, sf_dir).where(F.col("role") == "train").select("role", "sample_key", "pos", "shard", "shard_pos")


@query("shard_eval", with_views(SHARD_SQL.format("<> 'train'"), "shard_slots"))
def shard_eval(spark, sf_dir):
    return _shards(spark, sf_dir).where(F.col("role") != "train").select("role", "sample_key", "pos", "shard", "shard_pos")


@query(
    "batch_index",
    with_views(
        """SELECT role, CAST(shard AS INTEGER) AS shard, shard_pos // 64 AS batch_id, count(*) AS batch_rows,
                  min(sample_key) AS first_key, max(sample_key) AS last_key FROM shard_slots GROUP BY ALL""",
        "shard_slots",
    ),
)
def batch_index(spark, sf_dir):
    arrays = asm.batch_arrays(asm.batch(_shards(spark, sf_dir), BATCH), ["sample_key"])
    keys = F.transform("samples", lambda s: s["sample_key"])
    return arrays.select(
        "role",
        "shard",
        "batch_id",
        F.size("samples").cast("bigint").alias("batch_rows"),
        F.array_min(keys).alias("first_key"),
        F.array_max(keys).alias("last_key"),
    )


EPOCH_SQL = """SELECT role, CAST(shard AS INTEGER) AS shard, shard_pos // 64 AS batch_id, CAST(shard_pos % 64 AS INTEGER) AS batch_pos,
                  sample_key, y, x0, x1, x2, x3 FROM shard_slots WHERE {}"""


@query("epoch_loader", with_views(EPOCH_SQL.format("role <> 'train' OR shard_pos // 64 < n_total // 4 // 64"), "shard_slots"))
def epoch_loader(spark, sf_dir):
    """The loaders that training uses: the sampler drops the uneven tail, the loader its partial batch."""
    table = asm.epoch_table(v.role_samples(spark, sf_dir), "sample_key", BATCH, WORLD)
    return flat_x(table, "role", "shard", "batch_id", "batch_pos", "sample_key", "y")


@query("epoch_loader_keep", with_views(EPOCH_SQL.format("TRUE"), "shard_slots"))
def epoch_loader_keep(spark, sf_dir):
    """Sharded loaders whose sampler alone drops."""
    table = asm.epoch_table(v.role_samples(spark, sf_dir), "sample_key", BATCH, WORLD, drop_last=False)
    return flat_x(table, "role", "shard", "batch_id", "batch_pos", "sample_key", "y")


@query(
    "epoch_loader_single",
    with_views(
        """SELECT role, pos // 64 AS batch_id, CAST(pos % 64 AS INTEGER) AS batch_pos, sample_key FROM role_pos
           WHERE role <> 'train' OR pos // 64 < n_total // 64""",
        "role_pos",
    ),
)
def epoch_loader_single(spark, sf_dir):
    table = asm.epoch_table(v.role_samples(spark, sf_dir), "sample_key", BATCH)
    return table.select("role", "batch_id", "batch_pos", "sample_key")


def _log_samples(spark, sf_dir):
    planned = read_ranges(v.message_log(spark, sf_dir), v.split_plan(spark, sf_dir))
    return assign_rank(decode(planned, JSON)).withColumn("role", asm.role_of(F.col("split_idx"), 3))


LOG_LOADER_SQL = {
    "log_samples": """
        SELECT m.*, split_idx, CASE split_idx WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS role, m."partition" AS rank
        FROM message_log m JOIN split_plan p
        ON m."partition" = p."partition" AND m."offset" BETWEEN p.start_offset AND p.end_offset""",
}


@query(
    "log_loader",
    with_views(
        """SELECT role, rank, "offset", pos // 48 AS batch_id, CAST(pos % 48 AS INTEGER) AS batch_pos FROM (
               SELECT *, row_number() OVER (PARTITION BY role, rank ORDER BY CASE WHEN role = 'train'
                   THEN md5('42:0:' || "partition" || ':' || "offset" || ':0') END, "offset") - 1 AS pos FROM log_samples)""",
        "offsets",
        extra=plan_sql("offsets", v.SPLITS_FILLUP) | LOG_LOADER_SQL,
    ),
)
def log_loader(spark, sf_dir):
    """Each worker's own partition in batches of the total batch size over the workers; eval splits in offset order."""
    placed = asm.log_positions(_log_samples(spark, sf_dir))
    return asm.batch(placed, asm.per_worker_batch(192, WORLD), pos="pos", size="n_total").select(
        "role", "rank", "offset", "batch_id", "batch_pos"
    )


STATS_SQL = """SELECT role, n AS dataset_size, CASE WHEN n IS NOT NULL THEN 64 END AS batch_size, b AS num_batches,
                  b * 64 AS total_samples_per_epoch, CASE WHEN n IS NOT NULL THEN {drops} END AS drop_last
           FROM (SELECT r.role, n, CASE WHEN {drops} THEN n // 4 // 64
                        WHEN r.role = 'train' THEN (n // 4 + 63) // 64 ELSE ((n + 3) // 4 + 63) // 64 END AS b
                 FROM (VALUES ('train'), ('val'), ('test'), ('extra')) AS r(role)
                 LEFT JOIN (SELECT role, count(*) AS n FROM sample_split GROUP BY 1) USING (role)) AS r"""


@query("loader_stats_keep", with_views(STATS_SQL.format(drops="r.role = 'none'"), "sample_split"))
def loader_stats_keep(spark, sf_dir):
    return asm.loader_stats(v.role_samples(spark, sf_dir), BATCH, WORLD, (*asm.LOADERS, "extra"), drop_last=False)


@query("loader_stats", with_views(STATS_SQL.format(drops="r.role = 'train'"), "sample_split"))
def loader_stats(spark, sf_dir):
    return asm.loader_stats(v.role_samples(spark, sf_dir), BATCH, WORLD, (*asm.LOADERS, "extra"))


@query(
    "batch_info",
    with_views(
        """SELECT rank, CAST(ceil(count(*) FILTER (role = 'train') / 48) AS BIGINT) AS train_batches,
                  CAST(ceil(count(*) FILTER (role = 'val') / 48) AS BIGINT) AS val_batches,
                  CAST(ceil(count(*) FILTER (role = 'test') / 48) AS BIGINT) AS test_batches
           FROM log_samples GROUP BY rank""",
        "offsets",
        extra=plan_sql("offsets", v.SPLITS_FILLUP) | LOG_LOADER_SQL,
    ),
)
def batch_info(spark, sf_dir):
    return asm.batch_info(_log_samples(spark, sf_dir), 192, WORLD)


@query(
    "first_batch_profile",
    with_views(
        """SELECT role, CAST(shard AS INTEGER) AS shard, max(n_total) AS dataset_size, count(*) AS batch_rows, 4 AS data_width,
                  round(min(least(x0, x1, x2, x3)), 6) AS data_min, round(max(greatest(x0, x1, x2, x3)), 6) AS data_max,
                  string_agg(DISTINCT y, ',' ORDER BY y) AS labels, 'double' AS data_type, 'string' AS label_type
           FROM shard_slots WHERE shard_pos < 64 GROUP BY ALL""",
        "shard_slots",
    ),
)
def first_batch(spark, sf_dir):
    profile = asm.first_batch_profile(asm.batch(_shards(spark, sf_dir), BATCH), "x", "y")
    return (
        profile.withColumn("labels", F.array_join("labels", ","))
        .withColumn("data_min", F.round("data_min", 6))
        .withColumn("data_max", F.round("data_max", 6))
    )


@query(
    "sample_lookup",
    with_views(
        """SELECT role, pos, n_total AS length, sample_key, x0, x1, x2, x3 FROM role_pos WHERE pos = 11""", "role_pos"
    ),
)
def sample_lookup(spark, sf_dir):
    placed = asm.role_positions(v.role_samples(spark, sf_dir), "sample_key")
    return flat_x(asm.sample_at(placed, 11), "role", "pos", F.col("n_total").alias("length"), "sample_key")


