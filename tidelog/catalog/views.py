"""Inputs of the registered queries: the given tables seen as logs, samples, metrics, timings and checkpoints.

Every view has a Spark form and a SQL form. `with_views` puts the SQL forms a query needs before its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators.metrics import reduce_over_workers
from tidelog.plans.splits import normalize_splits, parse_offsets, plan_splits
from tidelog.sources.log import log_offsets

WORLD = 4
SPLITS_FILLUP = ({"rate": 0.85715}, {"rate": 0.071425}, {"rate": 0.071425})
SPLITS_RATE = tuple({**s, "fillup": False} for s in SPLITS_FILLUP)
SPLITS_HALF = ({"rate": 0.5}, {"rate": 0.5})
EXPERIMENTS = ["view", "click", "error", "purchase", "signup", "absent"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    """Microseconds since the epoch; sessions run in UTC."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def message_rows(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    body = F.to_json(F.struct(F.array("value", k).alias("x"), F.col("event_type").alias("y")))
    return events.select(
        F.lit("events").alias("topic"),
        (F.col("event_id") % WORLD).cast("int").alias("partition"),
        F.expr(f"event_id div {WORLD}").alias("offset"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.encode(F.col("user_id").cast("string"), "UTF-8").alias("key"),
        F.encode(body, "UTF-8").alias("value"),
    )


def message_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return message_rows(table(spark, sf_dir, "events"))


def cut_bodies(log: DataFrame) -> DataFrame:
    """Some bodies cut short, so that they cannot be decoded."""
    event_id = F.col("offset") * WORLD + F.col("partition")
    return log.withColumn(
        "value", F.when(event_id % 997 == 500, F.substring("value", 1, 5)).otherwise(F.col("value"))
    )


def message_log_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_bodies(message_log(spark, sf_dir))


def wrapped_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = F.struct(F.struct(F.base64("value").alias("Data")).alias("binary_data"))
    return message_log(spark, sf_dir).withColumn("value", F.encode(F.to_json(inner), "UTF-8"))


def offset_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_offsets(message_log(spark, sf_dir))


def offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_offsets(offset_texts(spark, sf_dir))


def _with_end(ranges: DataFrame, end: Column) -> DataFrame:
    return ranges.withColumn("end_offset", end).withColumn(
        "diff", F.col("end_offset") - F.col("start_offset") - 1
    )


def offsets_uneven(spark: SparkSession, sf_dir: str) -> DataFrame:
    lowered = F.greatest(F.col("start_offset"), F.col("end_offset") - F.col("partition") * 100)
    return _with_end(offsets(spark, sf_dir), lowered)


def offsets_tiny(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_end(offsets(spark, sf_dir), F.col("start_offset") + F.col("partition"))


def split_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_splits(offsets(spark, sf_dir), SPLITS_FILLUP)


def sample_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("x"), F.col("label").alias("y")
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components as class scores."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("embedding").cast("array<double>").alias("scores"),
        F.col("label").alias("target"),
        F.col("embedding").alias("x"),
    )


def sample_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat_ws(
        ":",
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.round(F.col("l_extendedprice") * 100).cast("bigint"),
        micros("l_shipdate"),
    )
    hundredth = F.conv(F.substring(F.md5("sample_key"), 1, 8), 16, 10).cast("bigint") % 100
    return (
        table(spark, sf_dir, "lineitem")
        .withColumn("sample_key", key)
        .withColumn("_h", hundredth)
        .select(
            "sample_key",
            F.when(F.col("_h") < 80, "train").when(F.col("_h") < 90, "val").otherwise("test").alias("split"),
            F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("x"),
            F.col("l_returnflag").alias("y"),
        )
    )


def role_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_split(spark, sf_dir).withColumnRenamed("split", "role")


def worker_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean discount per phase, epoch, worker and name, from whole hundredths so that every engine gets the same."""
    cents = F.sum(F.round(F.col("l_discount") * 100).cast("bigint"))
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.col("l_returnflag").alias("phase"),
            F.col("l_linenumber").alias("epoch"),
            (F.col("l_suppkey") % WORLD).cast("int").alias("rank"),
            F.col("l_linestatus").alias("name"),
        )
        .agg((cents / (F.count(F.lit(1)) * 100.0)).alias("value"))
    )


def reduced_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce_over_workers(worker_metrics(spark, sf_dir), WORLD)


def metric_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduced_metrics(spark, sf_dir).withColumn("value", F.round("value", 2))


def curve_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worker metrics read as one series per batch size."""
    return worker_metrics(spark, sf_dir).select(
        F.when(F.col("phase") == "A", "train").when(F.col("phase") == "N", "val").otherwise("test").alias("phase"),
        F.when(F.col("name") == "F", "accuracy").otherwise("loss").alias("name"),
        "epoch",
        F.expr("shiftleft(32, rank)").alias("batch_size"),
        "value",
    )


def metric_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.lit("train").alias("phase"),
        F.col("label").cast("string").alias("name"),
        (F.col("vec_id") + 1).alias("epoch"),
        F.col("embedding").alias("values"),
    )


def timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("experiment"),
        F.expr("event_id div 1000").cast("int").alias("iteration"),
        (F.col("event_id") % WORLD).cast("int").alias("rank"),
        F.col("value").alias("seconds"),
        "event_id",
    )


def timing_low(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing(spark, sf_dir).withColumn("seconds", F.lit(100.0) - F.col("seconds"))


def timer_rows(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type").isin("view", "click")).select(
        F.col("user_id").alias("name"),
        F.when(F.col("event_type") == "view", "start").otherwise("end").alias("kind"),
        micros("ts").alias("ts_us"),
        F.col("event_id").alias("seq"),
    )


def timer_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timer_rows(table(spark, sf_dir, "events"))


def checkpoint_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    orders = table(spark, sf_dir, "orders")
    return orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).select(
        F.col("c_name").alias("unique_key"),
        (F.col("o_orderkey") % 10).cast("int").alias("epoch"),
        micros("o_orderdate").alias("saved_at"),
        F.col("o_orderkey").alias("offset"),
        F.create_map(
            F.lit("w"),
            F.array(F.col("o_totalprice").cast("float")),
            F.lit("b"),
            F.slice(F.array(*[F.lit(0.5).cast("float")] * 9), 1, (F.col("o_orderkey") % 10).cast("int")),
        ).alias("params"),
    )


VIEW_SQL = {
    "message_log": """
        SELECT CAST(event_id % 4 AS INTEGER) AS "partition", event_id // 4 AS "offset", event_id, value AS x0,
               CAST(json_extract(props, '$.k') AS DOUBLE) AS x1, event_type AS y, event_id % 997 = 500 AS is_bad
        FROM events""",
    "offsets": """
        SELECT "partition", min("offset") AS start_offset, max("offset") AS end_offset FROM message_log GROUP BY 1""",
    "offsets_uneven": """
        SELECT "partition", start_offset, greatest(start_offset, end_offset - "partition" * 100) AS end_offset
        FROM offsets""",
    "offsets_tiny": """
        SELECT "partition", start_offset, start_offset + "partition" AS end_offset FROM offsets""",
    "sample_vec": "SELECT vec_id AS id, embedding AS x, label AS y FROM embeddings",
    "scores": """
        SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS scores, label AS target, embedding AS x
        FROM embeddings""",
    "keyed_lines": """
        SELECT concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                         CAST(round(l_extendedprice * 100) AS BIGINT), epoch_us(l_shipdate)) AS sample_key, *
        FROM lineitem""",
    "sample_split": """
        SELECT sample_key, l_quantity AS x0, l_extendedprice AS x1, l_discount AS x2, l_tax AS x3, l_returnflag AS y,
               CASE WHEN CAST('0x' || substr(md5(sample_key), 1, 8) AS BIGINT) % 100 < 80 THEN 'train'
                    WHEN CAST('0x' || substr(md5(sample_key), 1, 8) AS BIGINT) % 100 < 90 THEN 'val'
                    ELSE 'test' END AS role
        FROM keyed_lines""",
    "role_pos": """
        SELECT *, row_number() OVER (PARTITION BY role ORDER BY
                   CASE WHEN role = 'train' THEN md5('42:0:' || sample_key) ELSE md5(sample_key) END, sample_key) - 1 AS pos,
               count(*) OVER (PARTITION BY role) AS n_total
        FROM sample_split""",
    "shard_slots": """
        SELECT *, slot % 4 AS shard, slot // 4 AS shard_pos FROM (
            SELECT *, pos AS slot FROM role_pos WHERE role <> 'train' OR pos < n_total - n_total % 4
            UNION ALL
            SELECT *, pos + n_total AS slot FROM role_pos WHERE role <> 'train' AND pos < (4 - n_total % 4) % 4)""",
    "worker_metrics": """
        SELECT l_returnflag AS phase, l_linenumber AS epoch, CAST(l_suppkey % 4 AS INTEGER) AS rank, l_linestatus AS name,
               sum(CAST(round(l_discount * 100) AS BIGINT)) / (count(*) * CAST(100.0 AS DOUBLE)) AS value
        FROM lineitem GROUP BY ALL""",
    "reduced_metrics": """
        SELECT phase, epoch, name, sum(value) / 4 AS value FROM worker_metrics GROUP BY ALL""",
    "metric_ties": "SELECT phase, epoch, name, round(value, 2) AS value FROM reduced_metrics",
    "timing": """
        SELECT event_type AS experiment, CAST(event_id // 1000 AS INTEGER) AS iteration,
               CAST(event_id % 4 AS INTEGER) AS rank, value AS seconds, event_id FROM events""",
    "timing_low": "SELECT * REPLACE (100.0 - seconds AS seconds) FROM timing",
    "experiment_names": """
        SELECT * FROM (VALUES (0, 'view'), (1, 'click'), (2, 'error'), (3, 'purchase'), (4, 'signup'), (5, 'absent')) AS t(name_pos, experiment)""",
    "boxplot": """
        SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM (
            SELECT experiment, count(*) AS "count", quantile_cont(seconds, 0.25) AS q1, quantile_cont(seconds, 0.5) AS median,
                   quantile_cont(seconds, 0.75) AS q3, avg(seconds) AS mean, coalesce(var_samp(seconds), 0) AS variance,
                   coalesce(stddev_samp(seconds), 0) AS std_dev, min(seconds) AS "min", max(seconds) AS "max"
            FROM timing WHERE experiment IN (SELECT experiment FROM experiment_names) GROUP BY 1)""",
    "timer_events": """
        SELECT user_id AS name, CASE WHEN event_type = 'view' THEN 'start' ELSE 'end' END AS kind,
               epoch_us(ts) AS ts_us, event_id AS seq FROM events WHERE event_type IN ('view', 'click')""",
    "timer_ends": """
        SELECT * FROM (
            SELECT *, lag(kind) OVER w AS prev_kind, lag(ts_us) OVER w AS prev_us FROM timer_events
            WINDOW w AS (PARTITION BY name ORDER BY ts_us, seq)) WHERE kind = 'end'""",
    "timer_pairs": """
        SELECT name, seq, prev_us AS start_us, ts_us AS end_us, ts_us - prev_us AS duration_us
        FROM timer_ends WHERE prev_kind = 'start'""",
    "checkpoint_log": """
        SELECT c_name AS unique_key, CAST(o_orderkey % 10 AS INTEGER) AS epoch, epoch_us(o_orderdate) AS saved_at,
               o_orderkey AS "offset", CAST(o_totalprice AS FLOAT) AS w FROM orders JOIN customer ON o_custkey = c_custkey""",
}

# Which views a view reads.
VIEW_NEEDS = {
    "offsets": ["message_log"],
    "offsets_uneven": ["offsets"],
    "offsets_tiny": ["offsets"],
    "sample_split": ["keyed_lines"],
    "role_pos": ["sample_split"],
    "shard_slots": ["role_pos"],
    "reduced_metrics": ["worker_metrics"],
    "metric_ties": ["reduced_metrics"],
    "timing_low": ["timing"],
    "boxplot": ["timing", "experiment_names"],
    "timer_ends": ["timer_events"],
    "timer_pairs": ["timer_ends"],
}


def with_views(text: str, *views: str, extra: dict[str, str] | None = None) -> str:
    """The query with the views it needs, in order; `extra` views come after them."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in VIEW_NEEDS.get(name, []):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for view in views:
        add(view)
    parts = {name: VIEW_SQL[name] for name in ordered} | (extra or {})
    ctes = ",\n".join(f'"{name}" AS ({body})' for name, body in parts.items())
    return f"WITH {ctes}\n{text}" if parts else text


def plan_sql(source: str, splits, mode: str = "compat") -> dict[str, str]:
    """Views of a split plan, one split after the other; the last one is `split_plan`."""
    config = normalize_splits(splits)
    limit = "e" if mode == "compat" else "e + 1"
    out = {
        "plan_at_0": f'SELECT "partition", start_offset AS s, end_offset AS e, end_offset - start_offset - 1 AS diff FROM {source}'
    }
    for k, split in enumerate(config):
        width = f"greatest(1, CAST(round_even(diff * CAST({split.rate!r} AS DOUBLE), 0) AS BIGINT))"
        if split.fillup:
            width = f"max({width}) OVER ()"
        stop = "e" if k == len(config) - 1 else f"least(s + {width}, e)"
        out[f"range_{k}"] = f"SELECT *, {stop} AS stop FROM plan_at_{k}"
        out[f"plan_at_{k + 1}"] = f'SELECT "partition", least(stop + 1, {limit}) AS s, e, diff FROM range_{k}'
    out["split_plan"] = "\nUNION ALL\n".join(
        f'SELECT {k} AS split_idx, "partition", s AS start_offset, stop AS end_offset FROM range_{k}'
        for k in range(len(config))
    )
    return out
