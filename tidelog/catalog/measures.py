"""Queries over metrics, timers, experiments, checkpoints and saved results."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.catalog import views as v
from tidelog.catalog.registry import joined, query, r6
from tidelog.catalog.views import EXPERIMENTS, WORLD, with_views
from tidelog.operators import checkpoints as ckpt
from tidelog.operators import metrics as mt
from tidelog.operators import stats as st
from tidelog.operators import timing as tm
from tidelog.session import scratch_path
from tidelog.sources import results as rs

STEP_COLUMNS = ["phase", "epoch", "name"]


def rounded(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.round(c, 6) + F.lit(0.0))
    return df


# Metrics


@query(
    "metric_reduce_avg",
    with_views("SELECT phase, epoch, name, round(sum(value) / 4, 6) AS value FROM worker_metrics GROUP BY ALL", "worker_metrics"),
)
def reduce_avg(spark, sf_dir):
    return rounded(mt.reduce_over_workers(v.worker_metrics(spark, sf_dir), WORLD), "value")


@query(
    "metric_reduce_sum",
    with_views("SELECT phase, epoch, name, round(sum(value), 6) AS value FROM worker_metrics GROUP BY ALL", "worker_metrics"),
)
def reduce_sum(spark, sf_dir):
    return rounded(mt.reduce_over_workers(v.worker_metrics(spark, sf_dir), WORLD, average=False), "value")


@query(
    "metric_aggregate",
    with_views(
        """SELECT phase, epoch, name, reduction, round(CASE reduction WHEN 'mean' THEN s / 4 WHEN 'sum' THEN s
                  WHEN 'min' THEN lo ELSE hi END, 6) AS value
           FROM (SELECT phase, epoch, name, sum(value) AS s, min(value) AS lo, max(value) AS hi FROM worker_metrics GROUP BY ALL),
                (VALUES ('mean'), ('sum'), ('min'), ('max')) AS r(reduction)""",
        "worker_metrics",
    ),
)
def aggregate(spark, sf_dir):
    rows = v.worker_metrics(spark, sf_dir)
    parts = [mt.aggregate_scalars(rows, r, WORLD).withColumn("reduction", F.lit(r)) for r in mt.REDUCTIONS]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return rounded(out, "value")


@query(
    "metric_gather",
    with_views(
        """SELECT phase, epoch, CAST(dense_rank() OVER (PARTITION BY phase, epoch ORDER BY rank) - 1 AS INTEGER) AS pos, rank, name,
                  round(value, 6) AS value FROM worker_metrics""",
        "worker_metrics",
    ),
)
def gather(spark, sf_dir):
    gathered = mt.gather(v.worker_metrics(spark, sf_dir))
    return (
        gathered.select("phase", "epoch", F.posexplode("workers").alias("pos", "w"))
        .select("phase", "epoch", "pos", "w.rank", F.explode("w.metrics").alias("name", "value"))
        .withColumn("value", F.round("value", 6))
    )


@query(
    "metric_append",
    with_views("SELECT phase, epoch, name, round(value, 6) AS value FROM reduced_metrics", "reduced_metrics"),
)
def append(spark, sf_dir):
    path = scratch_path(spark, "metric-history")
    rows = v.reduced_metrics(spark, sf_dir)
    mt.append_history(rows.where(F.col("epoch") <= 3), path)
    mt.append_history(rows.where(F.col("epoch") > 3), path)
    return rounded(spark.read.schema("epoch int, name string, value double, phase string").parquet(path), "value").select(
        *STEP_COLUMNS, "value"
    )


@query(
    "metric_latest",
    with_views("SELECT phase, name, round(max_by(value, epoch), 6) AS latest FROM reduced_metrics GROUP BY ALL", "reduced_metrics"),
)
def latest(spark, sf_dir):
    return rounded(mt.latest(v.reduced_metrics(spark, sf_dir)), "latest")


HISTORY = "string_agg(CAST(round(value * 1000000) AS BIGINT), ',' ORDER BY epoch)"


@query(
    "metric_history",
    with_views(f"SELECT phase, name, 0 AS page, {HISTORY} AS values_e6 FROM reduced_metrics GROUP BY ALL", "reduced_metrics"),
)
def history(spark, sf_dir):
    return mt.history(v.reduced_metrics(spark, sf_dir)).select("phase", "name", "page", joined(F.col("values"), "values_e6"))


@query(
    "metric_last_n",
    with_views(
        """SELECT phase, name, round(coalesce(last3, 0), 6) AS last3, round(coalesce(whole, 0), 6) AS whole
           FROM (VALUES ('A', 'F'), ('N', 'O'), ('X', 'F')) AS w(phase, name) LEFT JOIN (
               SELECT phase, name, avg(value) FILTER (r <= 3) AS last3, avg(value) AS whole FROM (
                   SELECT *, row_number() OVER (PARTITION BY phase, name ORDER BY epoch DESC) AS r FROM reduced_metrics)
               GROUP BY ALL) USING (phase, name)""",
        "reduced_metrics",
    ),
)
def last_n(spark, sf_dir):
    wanted = [("A", "F"), ("N", "O"), ("X", "F")]
    rows = v.reduced_metrics(spark, sf_dir)
    newest = mt.average_of_last(rows, wanted, 3).withColumnRenamed("average", "last3")
    whole = mt.average_of_last(rows, wanted).withColumnRenamed("average", "whole")
    return rounded(newest.join(whole, ["phase", "name"]), "last3", "whole")


@query(
    "metric_best",
    with_views(
        """SELECT phase, name, 'max' AS mode, max(value) AS best_value, min(epoch) FILTER (value = hi) AS best_epoch
           FROM (SELECT *, max(value) OVER w AS hi, min(value) OVER w AS lo FROM metric_ties WINDOW w AS (PARTITION BY phase, name))
           GROUP BY ALL
           UNION ALL
           SELECT phase, name, 'min' AS mode, min(value) AS best_value, min(epoch) FILTER (value = lo) AS best_epoch
           FROM (SELECT *, max(value) OVER w AS hi, min(value) OVER w AS lo FROM metric_ties WINDOW w AS (PARTITION BY phase, name))
           GROUP BY ALL""",
        "metric_ties",
    ),
)
def best(spark, sf_dir):
    ties = v.metric_ties(spark, sf_dir)
    high = mt.best(ties, "max").withColumn("mode", F.lit("max"))
    return high.unionByName(mt.best(ties, "min").withColumn("mode", F.lit("min")))


@query(
    "metric_array_mean",
    """SELECT 'train' AS phase, CAST(label AS VARCHAR) AS name, round(max(m), 6) AS best_value, max_by(vec_id + 1, m) AS best_epoch
       FROM (SELECT *, list_sum(CAST(embedding AS DOUBLE[])) / len(embedding) AS m FROM embeddings) GROUP BY ALL""",
)
def array_mean(spark, sf_dir):
    rows = v.metric_arrays(spark, sf_dir).withColumn("value", mt.scalar(F.col("values")))
    return rounded(mt.best(rows), "best_value")


@query(
    "metric_summary",
    with_views(
        """SELECT phase, name, max_by(value, epoch) AS latest, max(value) AS best_value,
                  min(epoch) FILTER (value = hi) AS best_epoch, count(*) AS epochs
           FROM (SELECT *, max(value) OVER (PARTITION BY phase, name) AS hi FROM metric_ties) GROUP BY phase, name""",
        "metric_ties",
    ),
)
def summary(spark, sf_dir):
    return mt.summary(v.metric_ties(spark, sf_dir))


@query(
    "metric_snapshot",
    with_views(
        f"""SELECT 0 AS page, phase, name, {HISTORY} AS values_e6, (SELECT max(epoch) FROM reduced_metrics) AS current_epoch
            FROM reduced_metrics GROUP BY ALL""",
        "reduced_metrics",
    ),
)
def snapshot(spark, sf_dir):
    records = mt.snapshot(v.reduced_metrics(spark, sf_dir))
    return (
        records.select("page", "current_epoch", F.explode("metrics_history").alias("phase", "names"))
        .select("page", "current_epoch", "phase", F.explode("names").alias("name", "values"))
        .select("page", "phase", "name", joined(F.col("values"), "values_e6"), "current_epoch")
    )


@query(
    "metric_curves",
    with_views(
        """SELECT CASE phase WHEN 'A' THEN 'train' ELSE 'val' END AS phase, CASE name WHEN 'F' THEN 'accuracy' ELSE 'loss' END AS name,
                  epoch, round(max(value) FILTER (rank = 0), 6) AS bs_32, round(max(value) FILTER (rank = 1), 6) AS bs_64,
                  round(max(value) FILTER (rank = 2), 6) AS bs_128, round(max(value) FILTER (rank = 3), 6) AS bs_256, CAST(NULL AS DOUBLE) AS bs_512
           FROM worker_metrics WHERE phase IN ('A', 'N') GROUP BY ALL""",
        "worker_metrics",
    ),
)
def curves(spark, sf_dir):
    sizes = [32, 64, 128, 256, 512]
    return rounded(mt.curves(v.curve_metrics(spark, sf_dir), sizes), *[f"bs_{b}" for b in sizes])


# Timers


@query(
    "epoch_times",
    with_views(
        """SELECT e.name, starts AS current_epoch, coalesce(n, 0) AS epochs_completed, round(coalesce(total, 0) / 1e6, 3) AS total_epoch_time,
                  round(total / 1e6 / n, 3) AS average_epoch_time
           FROM (SELECT name, count(*) FILTER (kind = 'start') AS starts FROM timer_events GROUP BY 1) e
           LEFT JOIN (SELECT name, count(*) AS n, sum(duration_us) AS total FROM timer_pairs GROUP BY 1) p USING (name)""",
        "timer_pairs",
    ),
)
def epoch_times(spark, sf_dir):
    times = tm.epoch_times(v.timer_events(spark, sf_dir))
    return times.withColumn("total_epoch_time", F.round("total_epoch_time", 3)).withColumn(
        "average_epoch_time", F.round("average_epoch_time", 3)
    )


@query("timer_pairs", with_views("SELECT * FROM timer_pairs", "timer_pairs"))
def timer_pairs(spark, sf_dir):
    return tm.pair_timers(v.timer_events(spark, sf_dir))[0]


HOT = "CASE WHEN name % 10 = 0 THEN name ELSE -1 END"


@query(
    "timer_pairs_hot",
    with_views(
        f"""SELECT name, seq, prev AS start_us, ts_us AS end_us, ts_us - prev AS duration_us FROM (
                SELECT *, lag(ts_us) OVER o AS prev, lag(kind) OVER o AS prev_kind FROM (SELECT * REPLACE ({HOT} AS name) FROM timer_events)
                WINDOW o AS (PARTITION BY name ORDER BY ts_us, seq))
            WHERE kind = 'end' AND prev_kind = 'start'""",
        "timer_events",
    ),
)
def timer_pairs_hot(spark, sf_dir):
    """Nine of ten names taken as one."""
    return tm.pair_timers(v.timer_events(spark, sf_dir).withColumn("name", F.expr(HOT)))[0]


@query(
    "timer_unmatched",
    with_views("SELECT name, seq, ts_us FROM timer_ends WHERE prev_kind IS NULL OR prev_kind <> 'start'", "timer_ends"),
)
def timer_unmatched(spark, sf_dir):
    return tm.pair_timers(v.timer_events(spark, sf_dir))[1]


PROFILE = {"total": "sum", "avg": "avg", "min": "min", "max": "max"}


@query(
    "timer_profile",
    with_views(
        "SELECT name, count(*) AS \"count\", "
        + ", ".join(f'round({f}(duration_us) / 1e6, 3) AS "{c}"' for c, f in PROFILE.items())
        + " FROM timer_pairs GROUP BY 1",
        "timer_pairs",
    ),
)
def timer_profile(spark, sf_dir):
    profile = tm.timer_profile(tm.pair_timers(v.timer_events(spark, sf_dir))[0])
    return profile.select("name", "count", *[F.round(c, 3).alias(c) for c in PROFILE])


@query(
    "timer_lookup",
    with_views(
        """SELECT w.name, round(coalesce(avg(duration_us), 0) / 1e6, 3) AS average_time, round(coalesce(sum(duration_us), 0) / 1e6, 3) AS total_time
           FROM (VALUES (1), (7), (42), (-1)) AS w(name) LEFT JOIN timer_pairs p ON w.name = p.name GROUP BY w.name""",
        "timer_pairs",
    ),
)
def timer_lookup(spark, sf_dir):
    found = tm.timer_lookup(tm.pair_timers(v.timer_events(spark, sf_dir))[0], [1, 7, 42, -1])
    return found.select("name", F.round("average_time", 3).alias("average_time"), F.round("total_time", 3).alias("total_time"))


BATCH_SQL = """
    SELECT experiment, round(coalesce(total, 0), 4) AS total_time, round(coalesce(mean, 0), 6) AS mean_batch_time,
           round(coalesce(med, 0), 6) AS median_batch_time, coalesce(lo, 0) AS min_batch_time, coalesce(hi, 0) AS max_batch_time,
           coalesce(n, 0) AS num_batches
    FROM experiment_names LEFT JOIN (
        SELECT experiment, sum(seconds) AS total, avg(seconds) AS mean, median(seconds) AS med, min(seconds) AS lo,
               max(seconds) AS hi, count(*) AS n FROM timing {} GROUP BY 1) USING (experiment)"""


def _batch_timing(spark, sf_dir, max_batches):
    rows = v.timing(spark, sf_dir).withColumnRenamed("iteration", "batch_id")
    stats = tm.batch_timing(rows, EXPERIMENTS, max_batches).drop("batches_per_second")
    return rounded(stats, "mean_batch_time", "median_batch_time").withColumn("total_time", F.round("total_time", 4))


@query("batch_timing", with_views(BATCH_SQL.format(""), "timing", "experiment_names"))
def batch_timing(spark, sf_dir):
    return _batch_timing(spark, sf_dir, None)


@query("batch_timing_first", with_views(BATCH_SQL.format("WHERE iteration < 5"), "timing", "experiment_names"))
def batch_timing_first(spark, sf_dir):
    return _batch_timing(spark, sf_dir, 5)


# Experiments


@query(
    "experiment_summary",
    with_views(
        """SELECT n.experiment, count(seconds) AS "count", round(avg(seconds), 6) AS "avg", min(seconds) AS "min", max(seconds) AS "max"
           FROM experiment_names n LEFT JOIN timing USING (experiment) GROUP BY 1""",
        "timing",
        "experiment_names",
    ),
)
def experiment_summary(spark, sf_dir):
    return rounded(st.experiment_summary(v.timing(spark, sf_dir), EXPERIMENTS), "avg")


@query(
    "experiment_pool",
    with_views(
        "SELECT experiment, iteration, rank, seconds, event_id FROM timing JOIN experiment_names USING (experiment)",
        "timing",
        "experiment_names",
    ),
)
def experiment_pool(spark, sf_dir):
    return st.pool(v.timing(spark, sf_dir), EXPERIMENTS)


BOX = ["q1", "median", "q3", "iqr", "lower_fence", "upper_fence", "mean", "variance", "std_dev", "min", "max"]
BOX_SQL = ", ".join(f'round("{c}", 6) + 0 AS "{c}"' for c in BOX)


@query("boxplot_stats", with_views(f'SELECT experiment, "count", {BOX_SQL} FROM boxplot', "boxplot"))
def boxplot_stats(spark, sf_dir):
    return rounded(st.boxplot_stats(v.timing(spark, sf_dir), EXPERIMENTS), *BOX)


OUTLIERS = """
    SELECT event_id, experiment, seconds, CASE WHEN seconds < lower_fence THEN 'lower' ELSE 'upper' END AS side
    FROM timing JOIN boxplot USING (experiment) WHERE seconds < lower_fence OR seconds > upper_fence"""


@query("outliers", with_views(OUTLIERS, "boxplot"))
def outliers(spark, sf_dir):
    rows = v.timing(spark, sf_dir)
    return st.outliers(rows, st.boxplot_stats(rows, EXPERIMENTS)).select("event_id", "experiment", "seconds", "side")


@query(
    "outliers_low",
    with_views(
        """SELECT event_id, experiment, round(seconds, 6) AS seconds, 'lower' AS side FROM timing_low JOIN (
               SELECT experiment, q1 - 1.5 * (q3 - q1) AS fence FROM (
                   SELECT experiment, quantile_cont(seconds, 0.25) AS q1, quantile_cont(seconds, 0.75) AS q3 FROM timing_low GROUP BY 1))
           USING (experiment) WHERE seconds < fence""",
        "timing_low",
    ),
)
def outliers_low(spark, sf_dir):
    rows = v.timing_low(spark, sf_dir)
    found = st.outliers(rows, st.boxplot_stats(rows))
    return rounded(found, "seconds").select("event_id", "experiment", "seconds", "side")


@query(
    "analysis_all",
    with_views(
        f"""SELECT n.experiment, "count", {BOX_SQL}, CASE WHEN "count" IS NOT NULL THEN coalesce(n_lower, 0) END AS n_lower,
                   CASE WHEN "count" IS NOT NULL THEN coalesce(n_upper, 0) END AS n_upper, upper_outliers
            FROM experiment_names n LEFT JOIN boxplot b USING (experiment) LEFT JOIN (
                SELECT experiment, count(*) FILTER (side = 'lower') AS n_lower, count(*) FILTER (side = 'upper') AS n_upper,
                       string_agg(CAST(round(seconds * 1000000) AS BIGINT), ',' ORDER BY event_id) FILTER (side = 'upper' AND r <= 5) AS upper_outliers
                FROM (SELECT *, row_number() OVER (PARTITION BY experiment, side ORDER BY event_id) AS r FROM ({OUTLIERS}))
                GROUP BY 1) USING (experiment)""",
        "boxplot",
    ),
)
def analysis_all(spark, sf_dir):
    table = st.analyze(v.timing(spark, sf_dir), EXPERIMENTS, ["event_id"])
    return rounded(table, *BOX).select(
        "experiment", "count", *BOX, "n_lower", "n_upper", joined(F.col("upper_outliers"), "upper_outliers")
    )


MEANS = """
    SELECT experiment, avg(seconds) AS mean FROM timing WHERE experiment IN (SELECT experiment FROM experiment_names) GROUP BY 1"""


@query(
    "rank_experiments",
    with_views(
        f"""SELECT experiment, round(mean, 6) AS mean, CAST(r AS INTEGER) AS rank,
                   CASE r WHEN 1 THEN 'st' WHEN 2 THEN 'nd' WHEN 3 THEN 'rd' ELSE 'th' END AS rank_suffix
            FROM (SELECT *, row_number() OVER (ORDER BY mean, experiment) AS r FROM ({MEANS}))""",
        "timing",
        "experiment_names",
    ),
)
def rank_experiments(spark, sf_dir):
    return rounded(st.rank_experiments(st.experiment_means(v.timing(spark, sf_dir), EXPERIMENTS)), "mean")


@query(
    "ratio_to_best",
    with_views(
        f"""SELECT experiment, round(mean, 6) AS mean, round(mean / best, 6) AS ratio,
                   round(CASE WHEN mean > best THEN (mean / best - 1) * 100 END, 6) AS slowdown_pct
            FROM (SELECT *, min(mean) OVER () AS best FROM ({MEANS}))""",
        "timing",
        "experiment_names",
    ),
)
def ratio_to_best(spark, sf_dir):
    means = st.experiment_means(v.timing(spark, sf_dir), EXPERIMENTS)
    return rounded(st.ratio_to_best(means), "mean", "ratio", "slowdown_pct")


@query(
    "spread",
    with_views(
        f"""SELECT min_by(experiment, mean) AS best_performer, max_by(experiment, mean) AS worst_performer,
                   round(max(mean) - min(mean), 6) AS performance_spread, round((max(mean) - min(mean)) / max(mean) * 100, 6) AS relative_improvement
            FROM ({MEANS})""",
        "timing",
        "experiment_names",
    ),
)
def spread(spark, sf_dir):
    means = st.experiment_means(v.timing(spark, sf_dir), EXPERIMENTS)
    return rounded(st.spread(means), "performance_spread", "relative_improvement")


@query(
    "error_bars",
    with_views(
        """SELECT experiment, round(avg(seconds), 6) AS mean, round(stddev_samp(seconds), 6) AS std_samp, round(stddev_pop(seconds), 6) AS std_pop
           FROM timing WHERE experiment IN (SELECT experiment FROM experiment_names) GROUP BY 1""",
        "timing",
        "experiment_names",
    ),
)
def error_bars(spark, sf_dir):
    return rounded(st.error_bars(v.timing(spark, sf_dir), EXPERIMENTS), "mean", "std_samp", "std_pop")


# Saved results


def _saved(spark, sf_dir):
    path = scratch_path(spark, "results")
    rs.save_results(v.timing(spark, sf_dir), EXPERIMENTS, path)
    return path


@query(
    "results_roundtrip",
    with_views(f'SELECT experiment, "count", {BOX_SQL} FROM experiment_names LEFT JOIN boxplot USING (experiment)', "boxplot"),
)
def results_roundtrip(spark, sf_dir):
    stats = rs.load_results(spark, _saved(spark, sf_dir))[1]
    return rounded(stats, *BOX).select("experiment", "count", *BOX)


@query(
    "results_raw",
    with_views(
        "SELECT experiment, iteration, rank, seconds FROM timing JOIN experiment_names USING (experiment)",
        "timing",
        "experiment_names",
    ),
)
def results_raw(spark, sf_dir):
    return rs.load_results(spark, _saved(spark, sf_dir))[0]


@query(
    "results_metadata",
    with_views(
        """SELECT 6 AS total_experiments, count(*) AS total_data_points, 'tidelog' AS generated_by
           FROM timing JOIN experiment_names USING (experiment)""",
        "timing",
        "experiment_names",
    ),
)
def results_metadata(spark, sf_dir):
    return rs.load_metadata(spark, _saved(spark, sf_dir)).drop("timestamp")


# Checkpoints

CKPT_COLUMNS = 'unique_key, epoch, saved_at, "offset", round(CAST(w AS DOUBLE), 2) AS w'


def _flat(df, *more):
    first = F.round(F.get(F.element_at("params", "w"), F.lit(0)).cast("double"), 2)
    return df.select(*more, "unique_key", "epoch", "saved_at", "offset", first.alias("w"))


@query(
    "ckpt_save_latest",
    with_views(
        f"""SELECT {CKPT_COLUMNS} FROM (SELECT *, row_number() OVER (PARTITION BY unique_key ORDER BY saved_at DESC, "offset" DESC) AS r
            FROM checkpoint_log) WHERE r = 1""",
        "checkpoint_log",
    ),
)
def ckpt_save_latest(spark, sf_dir):
    path = scratch_path(spark, "checkpoints")
    log = v.checkpoint_log(spark, sf_dir)
    ckpt.save(log, path)
    return _flat(ckpt.latest_per_key(spark.read.schema(log.schema).parquet(path)))


KEY_PART = "000042"


@query(
    "ckpt_load_latest",
    with_views(
        f"""(SELECT 'part' AS mode, {CKPT_COLUMNS} FROM checkpoint_log WHERE contains(unique_key, '{KEY_PART}')
             ORDER BY unique_key DESC, saved_at DESC, "offset" DESC LIMIT 1)
            UNION ALL
            (SELECT 'all' AS mode, {CKPT_COLUMNS} FROM checkpoint_log ORDER BY unique_key DESC, saved_at DESC, "offset" DESC LIMIT 1)
            UNION ALL
            (SELECT 'time' AS mode, {CKPT_COLUMNS} FROM checkpoint_log ORDER BY saved_at DESC, "offset" DESC LIMIT 1)""",
        "checkpoint_log",
    ),
)
def ckpt_load_latest(spark, sf_dir):
    log = v.checkpoint_log(spark, sf_dir)
    found = {
        "part": ckpt.load_latest(log, KEY_PART),
        "all": ckpt.load_latest(log),
        "time": ckpt.load_latest(log, by="time"),
    }
    parts = [_flat(df, F.lit(mode).alias("mode")) for mode, df in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "ckpt_load_first",
    with_views(
        f"""SELECT {CKPT_COLUMNS} FROM checkpoint_log WHERE unique_key = 'Customer#000000007' ORDER BY "offset" LIMIT 1""",
        "checkpoint_log",
    ),
)
def ckpt_load_first(spark, sf_dir):
    return _flat(ckpt.load_first(v.checkpoint_log(spark, sf_dir), "Customer#000000007"))


@query("ckpt_list", with_views('SELECT unique_key, epoch, saved_at, "offset" FROM checkpoint_log', "checkpoint_log"))
def ckpt_list(spark, sf_dir):
    return ckpt.list_checkpoints(v.checkpoint_log(spark, sf_dir))


@query(
    "ckpt_retain",
    with_views(f'SELECT {CKPT_COLUMNS} FROM checkpoint_log ORDER BY saved_at DESC, "offset" DESC LIMIT 5', "checkpoint_log"),
)
def ckpt_retain(spark, sf_dir):
    return _flat(ckpt.retain_newest(v.checkpoint_log(spark, sf_dir)))


@query("ckpt_removed", with_views("SELECT greatest(count(*) - 5, 0) AS removed FROM checkpoint_log", "checkpoint_log"))
def ckpt_removed(spark, sf_dir):
    return ckpt.count_removed(v.checkpoint_log(spark, sf_dir))


@query(
    "ckpt_describe",
    with_views(
        """SELECT unique_key, epoch, saved_at, "offset", 'model,unique_key,epoch' AS keys, 'b,w' AS param_names, 1 + epoch AS model_parameters, 4 * (1 + epoch) AS param_bytes
           FROM checkpoint_log""",
        "checkpoint_log",
    ),
)
def ckpt_describe(spark, sf_dir):
    described = ckpt.describe(v.checkpoint_log(spark, sf_dir))
    return described.withColumns({c: F.array_join(c, ",") for c in ("keys", "param_names")})
