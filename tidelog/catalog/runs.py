"""Queries that run something: training, load experiments, worker tasks, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.catalog import views as v
from tidelog.catalog.logs import JSON, in_plan
from tidelog.catalog.registry import query, r6
from tidelog.catalog.views import WORLD, plan_sql, with_views
from tidelog.operators.assign import assign_rank, place_by_rank
from tidelog.operators.network import Sgd, evaluate_network, train_network
from tidelog.operators.timing import LoadConfig, batches_by_role, load_summary, run_load_experiment
from tidelog.operators.train import FeedForward, map_workers
from tidelog.session import scratch_path
from tidelog.sources.log import read_ranges
from tidelog.streaming.ingest import ingest, stream_parquet
from tidelog.streaming.timers import pair_timers_in_order, pair_timers_online, use_rocksdb
from tidelog.streaming.windows import windowed_metrics

#: The network of the training queries and how it is trained.
INPUTS, HIDDEN, CLASSES, SCALE = 64, 32, 10, 0.3
EPOCHS, STEPS, RATE, MOMENTUM = 3, 2, 0.1, 0.9


def role_vectors(spark, sf_dir):
    tenth = F.col("id") % 10
    role = F.when(tenth < 8, "train").when(tenth == 8, "val").otherwise("test")
    step = F.call_function("div", F.col("id"), F.lit(10)) % STEPS
    return v.sample_vec(spark, sf_dir).select(role.alias("role"), step.cast("int").alias("step"), "x", F.col("y").alias("label"))


#: Biases are the weights of an input and a hidden unit that are always one, numbered -1.
NETWORK_SQL = {
    "samples": f"""SELECT id, y, id // 10 % {STEPS} AS step, CASE WHEN id % 10 < 8 THEN 'train' WHEN id % 10 = 8 THEN 'val' ELSE 'test' END AS role
                   FROM sample_vec""",
    "inputs": """SELECT id, i, CAST(x[i + 1] AS DOUBLE) AS v FROM (SELECT id, x, unnest(range(0, len(x))) AS i FROM sample_vec)
                 UNION ALL SELECT id, -1, 1 FROM sample_vec""",
    "first_0": f"""SELECT i, j, CASE WHEN i < 0 THEN 0 ELSE {SCALE}::DOUBLE * sin(i * 0.7::DOUBLE + j * 1.3::DOUBLE) END AS w, 0::DOUBLE AS speed
                   FROM range(-1, {INPUTS}) AS a(i), range(0, {HIDDEN}) AS b(j)""",
    "second_0": f"""SELECT j, c, CASE WHEN j < 0 THEN 0 ELSE {SCALE}::DOUBLE * sin(j * 0.7::DOUBLE + c * 1.3::DOUBLE + 0.5::DOUBLE) END AS w, 0::DOUBLE AS speed
                    FROM range(-1, {HIDDEN}) AS a(j), range(0, {CLASSES}) AS b(c)""",
}


def forward_sql(run: str, rows: str, update: int) -> dict[str, str]:
    """Hidden values, class probabilities and outcomes of some rows under the weights after `update` updates."""
    return {
        f"hidden_{run}": f"""SELECT id, j, greatest(z, 0) AS h, z > 0 AS live FROM (
                                 SELECT id, j, sum(v * w) AS z FROM inputs JOIN first_{update} USING (i) JOIN samples USING (id) WHERE {rows} GROUP BY id, j)
                             UNION ALL SELECT id, -1, 1, FALSE FROM samples WHERE {rows}""",
        f"out_{run}": f"""SELECT id, y, c, o, exp(o - top) / sum(exp(o - top)) OVER (PARTITION BY id) AS p FROM (
                              SELECT id, c, o, max(o) OVER (PARTITION BY id) AS top FROM (
                                  SELECT id, c, sum(h * w) AS o FROM hidden_{run} JOIN second_{update} USING (j) GROUP BY id, c))
                          JOIN samples USING (id)""",
        f"outcome_{run}": f"""SELECT id, -ln(max(p) FILTER (c = y)) AS loss, CASE WHEN arg_max(c, o) = any_value(y) THEN 100.0 ELSE 0.0 END AS hit
                              FROM out_{run} GROUP BY id""",
    }


def update_sql(run: str, update: int) -> dict[str, str]:
    """Weights after one more update, by the mean gradient of the rows of a run."""
    speed, mean = f"{MOMENTUM}::DOUBLE * speed", f"(SELECT count(*) FROM outcome_{run})"
    return {
        f"second_{update + 1}": f"""SELECT j, c, w - {RATE}::DOUBLE * ({speed} + g) AS w, {speed} + g AS speed FROM second_{update} JOIN (
                                        SELECT j, c, sum(h * (p - CAST(c = y AS INTEGER))) / {mean} AS g
                                        FROM hidden_{run} JOIN out_{run} USING (id) GROUP BY j, c) USING (j, c)""",
        f"back_{run}": f"""SELECT id, j, sum((p - CAST(c = y AS INTEGER)) * w) AS e FROM out_{run} JOIN second_{update} USING (c)
                           JOIN hidden_{run} USING (id, j) WHERE live GROUP BY id, j""",
        f"first_{update + 1}": f"""SELECT i, j, w - {RATE}::DOUBLE * ({speed} + coalesce(g, 0)) AS w, {speed} + coalesce(g, 0) AS speed
                                   FROM first_{update} LEFT JOIN (SELECT i, j, sum(v * e) / {mean} AS g
                                                                  FROM back_{run} JOIN inputs USING (id) GROUP BY i, j) USING (i, j)""",
    }


def metrics_sql(phase: str, epoch: int, runs: list[str]) -> str:
    outcomes = " UNION ALL ".join(f"SELECT * FROM outcome_{run}" for run in runs)
    return f"""SELECT '{phase}' AS phase, {epoch} AS epoch, unnest(['accuracy', 'loss']) AS name,
                      unnest([round(avg(hit), 6), round(avg(loss), 6)]) AS value FROM ({outcomes}) HAVING count(*) > 0"""


def training_sql() -> str:
    """The whole training in SQL: each step reads the weights of the one before."""
    views, found = dict(NETWORK_SQL), []
    for epoch in range(1, EPOCHS + 1):
        runs = []
        for step in range(STEPS):
            update = (epoch - 1) * STEPS + step
            runs.append(f"train_{update}")
            views |= forward_sql(runs[-1], f"role = 'train' AND step = {step}", update) | update_sql(runs[-1], update)
        views |= forward_sql(f"val_{epoch}", "role = 'val'", epoch * STEPS)
        found += [metrics_sql("train", epoch, runs), metrics_sql("val", epoch, [f"val_{epoch}"])]
    views |= forward_sql("test", "role = 'test'", EPOCHS * STEPS)
    return with_views(" UNION ALL ".join([*found, metrics_sql("test", 1, ["test"])]), "sample_vec", extra=views).replace(" AS (", " AS MATERIALIZED (")


def network():
    return FeedForward.waves(INPUTS, HIDDEN, CLASSES, SCALE)


def rounded(metrics):
    return metrics.select("phase", "epoch", "name", r6("value", "value"))


@query("mlp_epochs", training_sql())
def mlp_epochs(spark, sf_dir):
    return rounded(train_network(role_vectors(spark, sf_dir), network(), Sgd(RATE, MOMENTUM), EPOCHS).metrics)


@query("test_eval", with_views(metrics_sql("test", 1, ["test"]), "sample_vec", extra=NETWORK_SQL | forward_sql("test", "role = 'test'", 0)))
def test_eval(spark, sf_dir):
    return rounded(evaluate_network(network(), role_vectors(spark, sf_dir)))


def _load_configs(spark, sf_dir):
    plan = v.split_plan(spark, sf_dir)
    return [
        LoadConfig("json_none", v.message_log(spark, sf_dir), plan, JSON),
        LoadConfig("json_bad", v.message_log_bad(spark, sf_dir), plan, JSON),
    ]


@query(
    "load_experiment",
    with_views(
        """SELECT experiment, rank, CAST(ceil(count(*) FILTER (split_idx = 0) / 48) AS BIGINT) AS train_batches,
                  CAST(ceil(count(*) FILTER (split_idx = 1) / 48) AS BIGINT) AS val_batches,
                  CAST(ceil(count(*) FILTER (split_idx = 2) / 48) AS BIGINT) AS test_batches
           FROM (SELECT experiment, split_idx, m."partition" AS rank
                 FROM message_log m JOIN split_plan p
                 ON m."partition" = p."partition" AND m."offset" BETWEEN p.start_offset AND p.end_offset,
                 (VALUES ('json_none'), ('json_bad')) AS e(experiment) WHERE experiment = 'json_none' OR NOT is_bad)
           GROUP BY ALL""",
        "offsets",
        extra=plan_sql("offsets", v.SPLITS_FILLUP),
    ),
)
def load_experiment(spark, sf_dir):
    return batches_by_role(run_load_experiment(_load_configs(spark, sf_dir), v.SPLITS_FILLUP, 192, WORLD)[1])


@query(
    "load_experiment_times",
    """SELECT experiment, 4 AS ranks, 2 AS iterations, TRUE AS in_order
       FROM (VALUES ('json_none'), ('json_bad')) AS e(experiment) WHERE (SELECT count(*) FROM events) > 0""",
)
def load_experiment_times(spark, sf_dir):
    """Wall times differ from run to run; their number and order do not."""
    timing, _ = run_load_experiment(_load_configs(spark, sf_dir), v.SPLITS_FILLUP, 192, WORLD, iterations=2)
    kept = timing.groupBy("experiment").agg(F.countDistinct("rank").cast("int").alias("ranks"), F.countDistinct("iteration").cast("int").alias("iterations"))
    low, mean, high = F.col("min_load_time"), F.col("avg_load_time"), F.col("max_load_time")
    in_order = (low >= 0) & (low <= mean + 1e-9) & (mean <= high + 1e-9)
    return load_summary(timing).join(kept, "experiment").select("experiment", kept.ranks, "iterations", in_order.alias("in_order"))


@query(
    "worker_tasks",
    in_plan('m."partition" AS rank, count(*) AS n, count(DISTINCT split_idx) AS splits', "TRUE GROUP BY 1"),
)
def worker_tasks(spark, sf_dir):
    """One task per worker counts the messages placed with it."""

    def count(batch):
        for row in batch.group_by(["rank", "split_idx"]).aggregate([([], "count_all")]).to_pylist():
            yield {"rank": row["rank"], "split_idx": row["split_idx"], "n": row["count_all"]}

    def task(batch):
        import pyarrow as pa

        yield from count(pa.Table.from_batches([batch]))

    planned = assign_rank(read_ranges(v.message_log(spark, sf_dir), v.split_plan(spark, sf_dir)))
    placed = place_by_rank(planned.select("rank", "split_idx", "offset"), WORLD)
    counted = map_workers(placed, task, "rank int, split_idx int, n bigint")
    return counted.groupBy("rank").agg(F.sum("n").alias("n"), F.countDistinct("split_idx").alias("splits"))


def _event_stream(spark, sf_dir):
    schema = v.table(spark, sf_dir, "events").schema
    return stream_parquet(spark, sf_dir, schema, pattern="events.parquet")


@query("stream_ingest", in_plan('split_idx, m."partition" AS "partition", "offset", is_bad, CASE WHEN NOT is_bad THEN x0 END AS x0, CASE WHEN NOT is_bad THEN y END AS y'))
def stream_ingest(spark, sf_dir):
    base = scratch_path(spark, "ingest")
    log = v.cut_bodies(v.message_rows(_event_stream(spark, sf_dir)))
    running = ingest(log, v.split_plan(spark, sf_dir), JSON, f"{base}/samples", f"{base}/dead", f"{base}/progress")
    running.awaitTermination()
    good = spark.read.parquet(f"{base}/samples").select(
        "split_idx", "partition", "offset", F.lit(False).alias("is_bad"), F.get("x", F.lit(0)).alias("x0"), "y"
    )
    bad = spark.read.parquet(f"{base}/dead").select(
        "split_idx",
        "partition",
        "offset",
        F.lit(True).alias("is_bad"),
        F.lit(None).cast("double").alias("x0"),
        F.lit(None).cast("string").alias("y"),
    )
    return good.unionByName(bad)


def _drain(df, base, spark):
    running = (
        df.writeStream.format("parquet")
        .option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/progress")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


@query("stream_timers", with_views("SELECT * FROM timer_pairs", "timer_pairs"))
def stream_timers(spark, sf_dir):
    use_rocksdb(spark)
    pairs = pair_timers_online(v.timer_rows(_event_stream(spark, sf_dir)))
    return _drain(pairs, scratch_path(spark, "timers"), spark)


@query(
    "stream_timers_ordered",
    with_views(
        """SELECT * FROM timer_pairs
           WHERE (end_us // 3600000000 + 1) * 3600000 <= (SELECT max(ts_us) // 1000 - 86400000 FROM timer_events)""",
        "timer_pairs",
    ),
)
def stream_timers_ordered(spark, sf_dir):
    """Pairs whose hour had ended a day before the last event."""
    use_rocksdb(spark)
    pairs = pair_timers_in_order(v.timer_rows(_event_stream(spark, sf_dir)), "1 day", slice_ms=3_600_000)
    return _drain(pairs, scratch_path(spark, "timers"), spark)


@query(
    "stream_metrics",
    """SELECT epoch_us(date_trunc('day', ts)) AS window_us, event_type AS name, count(*) AS n, round(avg(value), 6) AS mean,
              round(sum(value), 4) AS total, min(value) AS "min", max(value) AS "max"
       FROM events WHERE date_trunc('day', ts) < (SELECT date_trunc('day', max(ts)) FROM events) GROUP BY ALL""",
)
def stream_metrics(spark, sf_dir):
    events = _event_stream(spark, sf_dir).select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("name"), "value"
    )
    closed = _drain(windowed_metrics(events, "1 day"), scratch_path(spark, "windows"), spark)
    return closed.select(
        F.unix_micros("window_start").alias("window_us"),
        "name",
        "n",
        r6("mean", "mean"),
        F.round("total", 4).alias("total"),
        "min",
        "max",
    )
