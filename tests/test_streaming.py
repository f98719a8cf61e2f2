"""Streams over several micro-batches against the batch operators."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from tidelog.catalog import views as v
from tidelog.catalog.logs import JSON
from tidelog.operators.timing import pair_timers
from tidelog.session import scratch_path
from tidelog.sources.decode import dead_letter, decode
from tidelog.sources.log import read_ranges
from tidelog.streaming.ingest import ingest, stream_parquet
from tidelog.streaming.timers import pair_timers_in_order, pair_timers_online, use_rocksdb
from tidelog.streaming.windows import windowed_metrics

PARTS = 3


def append_file(df, folder, position):
    """One more file of a stream, with a modification time that fixes its place in the order of arrival."""
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    df.coalesce(1).write.mode("append").parquet(folder)
    stamp = time.time() - 3600 + 60 * position
    for name in set(os.listdir(folder)) - before:
        os.utime(os.path.join(folder, name), (stamp, stamp))


@pytest.fixture(scope="module")
def parts(spark, sf_dir, tmp_path_factory):
    """The events as several files, in time order."""
    folder = tmp_path_factory.mktemp("events")
    events = v.table(spark, sf_dir, "events").orderBy("event_id")
    n = events.count()
    for i in range(PARTS):
        piece = events.where(F.col("event_id").between(i * n // PARTS, (i + 1) * n // PARTS - 1))
        append_file(piece, str(folder), i)
    return str(folder), events.schema


def stream(spark, parts):
    return stream_parquet(spark, *parts, files_per_trigger=1)


def drain(spark, df):
    base = scratch_path(spark, "test-stream")
    writer = df.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/c")
    running = writer.outputMode("append").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out"), len([p for p in running.recentProgress if p.numInputRows])


def test_ingest_equals_batch(spark, sf_dir, parts):
    plan = v.split_plan(spark, sf_dir)
    base = scratch_path(spark, "test-ingest")
    log = v.cut_bodies(v.message_rows(stream(spark, parts)))
    for _ in range(2):  # The second run finds nothing new and changes nothing.
        ingest(log, plan, JSON, f"{base}/good", f"{base}/bad", f"{base}/c").awaitTermination()
    good, bad = dead_letter(decode(read_ranges(v.message_log_bad(spark, sf_dir), plan), JSON))
    key = ["split_idx", "partition", "offset"]
    got = spark.read.parquet(f"{base}/good")
    assert got.select("batch").distinct().count() == PARTS
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, good.select(*key).collect()))
    assert sorted(map(tuple, spark.read.parquet(f"{base}/bad").select(*key).collect())) == sorted(
        map(tuple, bad.select(*key).collect())
    )


def test_timers_equal_batch(spark, sf_dir, parts):
    use_rocksdb(spark)
    got, batches = drain(spark, pair_timers_online(v.timer_rows(stream(spark, parts))))
    assert batches == PARTS
    want = pair_timers(v.timer_events(spark, sf_dir))[0].select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_shuffled_timers_equal_batch(spark, sf_dir, tmp_path):
    use_rocksdb(spark)
    events = v.timer_events(spark, sf_dir).select("name", "kind", "ts_us", "seq")
    far = events.agg(F.lit(None).cast(events.schema["name"].dataType).alias("name"), F.lit("start").alias("kind"), (F.max("ts_us") + 10**15).alias("ts_us"), F.max("seq").alias("seq"))
    for i in range(5):
        append_file(events.where(F.pmod(F.xxhash64("seq", "ts_us"), F.lit(5)) == i), str(tmp_path), i)
    append_file(far, str(tmp_path), 5)
    shuffled = stream_parquet(spark, str(tmp_path), events.schema, files_per_trigger=1)
    got, batches = drain(spark, pair_timers_in_order(shuffled, "3650 days", slice_ms=3_600_000))
    assert batches == 6
    want = pair_timers(events)[0].select(*got.columns)
    assert want.count() > 0
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_events_after_the_watermark_are_dropped(spark, tmp_path):
    use_rocksdb(spark)
    schema = "name string, kind string, ts_us bigint, seq bigint"
    files = ["('a', 'end', 5000000, 2), ('a', 'start', NULL, 9)", "('a', 'start', 2000000, 1)", "('b', 'start', 90000000, 3)", "('b', 'start', 90000000, 3)",
             "('a', 'end', 6000000, 4), ('b', 'end', 95000000, 5)", "('c', 'start', 900000000, 6)"]
    for i, values in enumerate(files):
        append_file(spark.sql(f"SELECT * FROM VALUES {values} AS t(name, kind, ts_us, seq)").select(*[F.col(c).cast(t).alias(c) for c, t in (x.split() for x in schema.split(", "))]), str(tmp_path), i)
    got, _ = drain(spark, pair_timers_in_order(stream_parquet(spark, str(tmp_path), schema, files_per_trigger=1), "10 seconds"))
    assert sorted(map(tuple, got.collect())) == [("a", 2, 2000000, 5000000, 3000000), ("b", 5, 90000000, 95000000, 5000000)]


def test_waiting_events_take_one_state_row_a_slice(spark, tmp_path):
    use_rocksdb(spark)
    n = 300
    rows = spark.range(n).select(F.lit("a").alias("name"), F.when(F.col("id") % 2 == 0, "start").otherwise("end").alias("kind"), (F.col("id") * 1_000_000).alias("ts_us"), F.col("id").alias("seq"))
    append_file(rows, str(tmp_path), 0)
    append_file(rows.where("seq < 1").withColumn("ts_us", F.lit(10**10)), str(tmp_path), 1)
    running = (
        pair_timers_in_order(stream_parquet(spark, str(tmp_path), rows.schema, files_per_trigger=1), "10 seconds")
        .writeStream.format("memory").queryName("waiting").trigger(availableNow=True).start()
    )
    running.awaitTermination()
    assert max(sum(op["numRowsTotal"] for op in json.loads(p.json)["stateOperators"]) for p in running.recentProgress) <= n + 2
    assert spark.table("waiting").agg(F.count("name"), F.sum("duration_us")).first()[:] == (n // 2, n // 2 * 1_000_000)


def test_events_of_open_slices_are_kept(spark, tmp_path):
    use_rocksdb(spark)
    files = ["('a', 'start', 61000000, 1), ('b', 'start', 90000000, 2)", "('b', 'end', 91000000, 3)", "('a', 'end', 70000000, 4)", "('a', 'end', 200000000, 5), ('c', 'start', 900000000, 6)"]
    for i, values in enumerate(files):
        append_file(spark.sql(f"SELECT name, kind, CAST(ts_us AS BIGINT) AS ts_us, CAST(seq AS BIGINT) AS seq FROM VALUES {values} AS t(name, kind, ts_us, seq)"), str(tmp_path), i)
    arriving = stream_parquet(spark, str(tmp_path), "name string, kind string, ts_us bigint, seq bigint", files_per_trigger=1)
    got, _ = drain(spark, pair_timers_in_order(arriving, "10 seconds", slice_ms=60_000))
    assert sorted(map(tuple, got.collect())) == [("a", 4, 61000000, 70000000, 9000000), ("b", 3, 90000000, 91000000, 1000000)]


def test_closed_windows_equal_batch(spark, sf_dir, parts):
    def metrics(df):
        return df.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("name"), "value")

    got, _ = drain(spark, windowed_metrics(metrics(stream(spark, parts)), "1 day"))
    rows = metrics(v.table(spark, sf_dir, "events"))
    last_day = rows.agg(F.date_trunc("day", F.max("ts"))).first()[0]
    days = rows.where(F.col("ts") < F.lit(last_day)).groupBy(F.date_trunc("day", "ts").alias("d"), "name").agg(
        F.count("value").alias("n"), F.max("value").alias("max")
    )
    assert sorted(map(tuple, got.select("window_start", "name", "n", "max").collect())) == sorted(map(tuple, days.collect()))


def test_late_rows_are_dropped(spark, tmp_path):
    # A row is late against the watermark of the batch before, so the late file comes two files after the jump.
    folder = str(tmp_path / "late")
    schema = "ts timestamp, name string, value double"
    for i, day in enumerate(("2024-01-01", "2024-01-05", "2024-01-05", "2024-01-01", "2024-01-09")):
        row = spark.sql(f"SELECT timestamp'{day} 10:00:00' AS ts, 'm' AS name, 1.0D AS value")
        append_file(row, folder, i)
    got, _ = drain(spark, windowed_metrics(stream_parquet(spark, folder, schema, files_per_trigger=1), "1 day"))
    counts = {str(r["window_start"])[:10]: r["n"] for r in got.collect()}
    assert counts == {"2024-01-01": 1, "2024-01-05": 2}
