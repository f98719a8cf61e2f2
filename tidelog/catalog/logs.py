"""Queries over the message log: offsets, plans, bounded reads, decoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.catalog import views as v
from tidelog.catalog.registry import query, r6
from tidelog.catalog.views import WORLD, plan_sql, with_views
from tidelog.operators.assign import assign_rank, bootstrap_fillup
from tidelog.operators.assemble import role_of
from tidelog.plans import splits as plans
from tidelog.schemas import JSON_SAMPLE, Payload
from tidelog.sources.avro import encode_samples
from tidelog.sources.decode import dead_letter, decode, decode_json, strict_prefix, unwrap_base64
from tidelog.sources.log import log_scan, read_ranges

JSON = Payload(message_format="none")
PLAN_COLUMNS = (
    'SELECT split_idx, "partition", start_offset, end_offset, end_offset - start_offset + 1 AS n_messages,'
    " start_offset > end_offset AS is_empty FROM split_plan"
)
SAMPLE_COLUMNS = '"partition", "offset", x0, x1, y'


def sample_columns(df, *more):
    return df.select(
        *more, "partition", "offset", F.get("x", F.lit(0)).alias("x0"), F.get("x", F.lit(1)).alias("x1"), "y"
    )


def in_plan(columns: str, where: str = "TRUE", source: str = "offsets") -> str:
    text = f"""
        SELECT {columns} FROM message_log m JOIN split_plan p
        ON m."partition" = p."partition" AND m."offset" BETWEEN p.start_offset AND p.end_offset WHERE {where}"""
    return with_views(text, source, "message_log", extra=plan_sql(source, v.SPLITS_FILLUP))


@query(
    "offset_parse",
    with_views(
        'SELECT "partition", start_offset, end_offset, end_offset - start_offset - 1 AS diff FROM offsets', "offsets"
    ),
)
def offset_parse(spark, sf_dir):
    return v.offsets(spark, sf_dir).select("partition", "start_offset", "end_offset", "diff")


@query(
    "offset_distribution",
    with_views(
        """SELECT CAST(sum(n) AS BIGINT) AS total_records, round(avg(n), 6) AS avg_records_per_partition,
                  round(sum(n) / 4, 6) AS avg_records_per_process, min(n) AS min_partition_size,
                  max(n) AS max_partition_size, string_agg(n, ',' ORDER BY "partition") AS partition_sizes
           FROM (SELECT "partition", end_offset - start_offset AS n FROM offsets_uneven)""",
        "offsets_uneven",
    ),
)
def offset_distribution(spark, sf_dir):
    return plans.offset_distribution(v.offsets_uneven(spark, sf_dir), WORLD).select(
        "total_records",
        r6("avg_records_per_partition", "avg_records_per_partition"),
        r6("avg_records_per_process", "avg_records_per_process"),
        "min_partition_size",
        "max_partition_size",
        F.array_join("partition_sizes", ",").alias("partition_sizes"),
    )


@query(
    "partition_worker_check",
    with_views(
        """SELECT n_partitions, n_offset_strings, 4 AS world_size, n_partitions = 4 AS partitions_match,
                  n_offset_strings = 4 AS strings_match
           FROM (SELECT count(DISTINCT "partition") AS n_partitions FROM message_log),
                (SELECT count(*) AS n_offset_strings FROM offsets)""",
        "offsets",
    ),
)
def partition_worker_check(spark, sf_dir):
    return plans.partition_worker_check(v.message_log(spark, sf_dir), v.offset_texts(spark, sf_dir), WORLD)


def _plan_query(name, source, view, splits, mode="compat"):
    @query(name, with_views(PLAN_COLUMNS, source, extra=plan_sql(source, splits, mode)))
    def run(spark, sf_dir):
        return plans.split_report(plans.plan_splits(view(spark, sf_dir), splits, mode))

    return run


_plan_query("split_plan_fillup", "offsets_uneven", v.offsets_uneven, v.SPLITS_FILLUP)
_plan_query("split_plan_rate", "offsets_uneven", v.offsets_uneven, v.SPLITS_RATE)
_plan_query("split_plan_overlap", "offsets_tiny", v.offsets_tiny, v.SPLITS_HALF)
_plan_query("split_plan_disjoint", "offsets_tiny", v.offsets_tiny, v.SPLITS_HALF, "disjoint")


@query(
    "log_scan",
    with_views(
        """SELECT CASE WHEN NOT is_bad THEN x0 END AS x0, CASE WHEN NOT is_bad THEN x1 END AS x1,
                  CASE WHEN NOT is_bad THEN y END AS y FROM message_log""",
        "message_log",
    ),
)
def scan(spark, sf_dir):
    return log_scan(v.message_log_bad(spark, sf_dir), JSON_SAMPLE).select(
        F.get("x", F.lit(0)).alias("x0"), F.get("x", F.lit(1)).alias("x1"), "y"
    )


@query(
    "split_apply",
    in_plan(
        'split_idx, m."partition" AS "partition", count(*) AS n, round(avg(x0), 6) AS mean_x0,'
        " min(m.\"offset\") AS first_offset, max(m.\"offset\") AS last_offset",
        "TRUE GROUP BY 1, 2",
    ),
)
def split_apply(spark, sf_dir):
    """How many messages, and what mean value, each split of each partition gets."""
    planned_log = read_ranges(v.message_log(spark, sf_dir), v.split_plan(spark, sf_dir))
    return (
        decode(planned_log, JSON)
        .groupBy("split_idx", "partition")
        .agg(
            F.count(F.lit(1)).alias("n"),
            r6(F.avg(F.get("x", F.lit(0))), "mean_x0"),
            F.min("offset").alias("first_offset"),
            F.max("offset").alias("last_offset"),
        )
    )


@query(
    "split_apply_many",
    with_views(
        """SELECT split_idx, count(*) AS n, min(m."offset") AS first_offset, max(m."offset") AS last_offset FROM message_log m
           JOIN (SELECT p_partkey AS split_idx, p_partkey AS start_offset, p_partkey + p_size * p_size AS end_offset FROM part) p
           ON m."partition" = 0 AND m."offset" BETWEEN p.start_offset AND p.end_offset GROUP BY 1""",
        "message_log",
    ),
)
def split_apply_many(spark, sf_dir):
    """One range for each part, all on one partition."""
    key, size = F.col("p_partkey"), F.col("p_size")
    ranges = v.table(spark, sf_dir, "part").select(key.alias("split_idx"), F.lit(0).alias("partition"), key.alias("start_offset"), (key + size * size).alias("end_offset"))
    held = read_ranges(v.message_log(spark, sf_dir), ranges)
    return held.groupBy("split_idx").agg(F.count(F.lit(1)).alias("n"), F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"))


@query(
    "range_pull",
    with_views(
        f"""SELECT {SAMPLE_COLUMNS} FROM message_log JOIN offsets_uneven USING ("partition")
            WHERE "offset" BETWEEN start_offset AND end_offset""",
        "offsets_uneven",
    ),
)
def range_pull(spark, sf_dir):
    whole = plans.plan_splits(v.offsets_uneven(spark, sf_dir), None)
    return sample_columns(decode(read_ranges(v.message_log(spark, sf_dir), whole), JSON))


@query(
    "decode_json",
    with_views(
        """SELECT "partition", "offset", CASE WHEN NOT is_bad THEN x0 END AS x0, CASE WHEN NOT is_bad THEN x1 END AS x1,
                  CASE WHEN NOT is_bad THEN y END AS y, is_bad FROM message_log""",
        "message_log",
    ),
)
def json_rows(spark, sf_dir):
    decoded = decode_json(v.message_log_bad(spark, sf_dir), JSON)
    return sample_columns(decoded, "is_bad")


@query(
    "decode_missing_fields",
    with_views('SELECT "partition", "offset", CAST(NULL AS DOUBLE) AS x0, y FROM message_log', "message_log"),
)
def missing_fields(spark, sf_dir):
    decoded = decode(v.message_log(spark, sf_dir), Payload(message_format="none", data_field="data", label_field="y"))
    return decoded.select("partition", "offset", F.get("x", F.lit(0)).alias("x0"), "y")


@query("decode_wrapped_base64", with_views(f"SELECT {SAMPLE_COLUMNS} FROM message_log", "message_log"))
def wrapped(spark, sf_dir):
    return sample_columns(decode_json(unwrap_base64(v.wrapped_log(spark, sf_dir)), JSON))


@query(
    "decode_strict_prefix",
    with_views(
        f"""SELECT split_idx, {SAMPLE_COLUMNS} FROM (
                SELECT split_idx, m.*, min(CASE WHEN is_bad THEN "offset" END) OVER (PARTITION BY split_idx, m."partition") AS bad
                FROM message_log m JOIN split_plan p
                ON m."partition" = p."partition" AND m."offset" BETWEEN p.start_offset AND p.end_offset)
            WHERE bad IS NULL OR "offset" < bad""",
        "offsets",
        extra=plan_sql("offsets", v.SPLITS_FILLUP),
    ),
)
def prefix(spark, sf_dir):
    decoded = decode(read_ranges(v.message_log_bad(spark, sf_dir), v.split_plan(spark, sf_dir)), JSON)
    return sample_columns(strict_prefix(decoded), "split_idx")


@query("decode_dead_letter", in_plan('split_idx, m."partition" AS "partition", "offset"', "is_bad"))
def dead(spark, sf_dir):
    decoded = decode(read_ranges(v.message_log_bad(spark, sf_dir), v.split_plan(spark, sf_dir)), JSON)
    return dead_letter(decoded)[1].select("split_idx", "partition", "offset")


@query(
    "rank_assignment",
    in_plan('split_idx, m."partition" AS rank, "offset"'),
)
def ranks(spark, sf_dir):
    placed = assign_rank(read_ranges(v.message_log(spark, sf_dir), v.split_plan(spark, sf_dir)))
    return placed.select("split_idx", "rank", "offset")


FILLUP_SQL = {
    "own": """
        SELECT m."partition", "offset", row_number() OVER (PARTITION BY m."partition" ORDER BY "offset") - 1 AS i,
               count(*) OVER (PARTITION BY m."partition") AS n
        FROM message_log m JOIN split_plan p
        ON p.split_idx = 2 AND m."partition" = p."partition" AND m."offset" BETWEEN p.start_offset AND p.end_offset""",
    "goal": "SELECT max(end_offset - start_offset) + 1 AS target FROM split_plan WHERE split_idx = 2",
    "short": 'SELECT DISTINCT "partition", n, target FROM own, goal WHERE n < target',
    "numbered": 'SELECT "partition", n, unnest(range(1, target - n + 1)) AS k FROM short',
    "draws": """
        SELECT "partition", CAST('0x' || substr(md5('0:' || "partition" || ':' || k), 1, 15) AS BIGINT) % n AS i
        FROM numbered""",
    "extra": 'SELECT "partition", i, count(*) AS c FROM draws GROUP BY ALL',
}


@query(
    "fillup_bootstrap",
    with_views(
        """SELECT 2 AS split_idx, "partition", "offset", unnest(range(0, coalesce(c, 0) + 1)) AS copy
           FROM own LEFT JOIN extra USING ("partition", i)
           UNION ALL
           SELECT split_idx, m."partition", "offset", 0 AS copy FROM message_log m JOIN split_plan p
           ON p.split_idx < 2 AND m."partition" = p."partition" AND m."offset" BETWEEN p.start_offset AND p.end_offset""",
        "offsets_uneven",
        extra=plan_sql("offsets_uneven", v.SPLITS_FILLUP) | FILLUP_SQL,
    ),
)
def fillup(spark, sf_dir):
    plan = plans.plan_splits(v.offsets_uneven(spark, sf_dir), v.SPLITS_FILLUP)
    samples = read_ranges(v.message_log(spark, sf_dir), plan).select("split_idx", "partition", "offset")
    return bootstrap_fillup(samples, plan, v.SPLITS_FILLUP)


@query(
    "split_roles",
    with_views(
        """SELECT n_splits, split_idx, role, split_idx < n_splits - 1 AS has_next, count(*) AS partitions
           FROM (VALUES (1, 0, 'train'), (2, 0, 'train'), (2, 1, 'test'), (3, 0, 'train'), (3, 1, 'val'), (3, 2, 'test'))
               AS t(n_splits, split_idx, role), offsets GROUP BY ALL""",
        "offsets",
    ),
)
def roles(spark, sf_dir):
    ranges = v.offsets(spark, sf_dir)
    configs = [None, v.SPLITS_HALF, v.SPLITS_FILLUP]
    parts = [
        plans.plan_splits(ranges, config)
        .withColumn("n_splits", F.lit(n))
        .withColumn("role", role_of(F.col("split_idx"), n))
        for n, config in enumerate(configs, 1)
    ]
    return (
        parts[0]
        .unionByName(parts[1])
        .unionByName(parts[2])
        .groupBy("n_splits", "split_idx", "role", (F.col("split_idx") < F.col("n_splits") - 1).alias("has_next"))
        .agg(F.count(F.lit(1)).alias("partitions"))
    )


def sample_bodies(spark, sf_dir):
    """The vectors as encoded sample records."""
    vectors = v.sample_vec(spark, sf_dir).select(
        F.col("id").alias("offset"),
        F.col("x").alias("data"),
        F.array(F.lit(1), F.lit(8), F.lit(8)).alias("shape"),
        F.col("y").alias("label"),
        F.struct(
            F.lit("embeddings").alias("dataset"), F.lit("train").alias("split"), F.col("id").cast("int").alias("index")
        ).alias("meta"),
    )
    return encode_samples(vectors)


DECODED_SQL = """
    SELECT vec_id AS "offset",
           CAST(list_sum(list_transform(embedding, lambda e: CAST(round(CAST(e AS DOUBLE) * 1000000) AS BIGINT))) AS BIGINT) AS x_sum_e6,
           CAST(len(embedding) AS INTEGER) AS width, label AS y, {bad} AS is_bad FROM embeddings"""
AVRO = {"data_field": "data", "label_field": "label"}


def _decoded_columns(decoded):
    total = F.aggregate(
        F.transform("x", lambda e: F.round(e.cast("double") * 1e6).cast("bigint")),
        F.lit(0).cast("bigint"),
        lambda acc, e: acc + e,
    )
    return decoded.select("offset", total.alias("x_sum_e6"), F.size("x").alias("width"), "y", "is_bad")


@query("decode_avro", DECODED_SQL.format(bad="FALSE"))
def avro(spark, sf_dir):
    return _decoded_columns(decode(sample_bodies(spark, sf_dir), Payload("avro", **AVRO)))


@query("decode_wrapped_avro", DECODED_SQL.format(bad="FALSE"))
def wrapped_avro(spark, sf_dir):
    inner = F.struct(F.struct(F.base64("value").alias("Data")).alias("binary_data"))
    bodies = sample_bodies(spark, sf_dir).withColumn("value", F.encode(F.to_json(inner), "UTF-8"))
    return _decoded_columns(decode(bodies, Payload("mongodb_avro", **AVRO)))


@query(
    "decode_avro_cut",
    """SELECT vec_id AS "offset", vec_id % 7 = 3 AS is_bad, CASE WHEN vec_id % 7 <> 3 THEN label END AS y FROM embeddings""",
)
def avro_cut(spark, sf_dir):
    """Bodies cut short are bad; the others still decode."""
    cut = F.when(F.col("offset") % 7 == 3, F.substring("value", 1, 40)).otherwise(F.col("value"))
    bodies = sample_bodies(spark, sf_dir).withColumn("value", cut)
    return decode(bodies, Payload("avro", **AVRO)).select("offset", "is_bad", "y")
