import pytest
from pyspark.sql import functions as F

from tidelog.operators import metrics as mt
from tidelog.operators import timing as tm
from tidelog.operators.ordered import with_previous_scan
from tidelog.session import local_table

COLUMNS = "phase string, epoch int, rank int, name string, value double"


def metric_rows(spark, rows):
    names = ("phase", "epoch", "rank", "name", "value")
    return local_table(spark, [dict(zip(names, r)) for r in rows], COLUMNS)


def series(spark, values, phase="train", name="loss"):
    rows = [{"phase": phase, "epoch": i, "name": name, "value": v} for i, v in enumerate(values, 1)]
    return local_table(spark, rows, "phase string, epoch int, name string, value double")


def test_average_divides_by_workers_not_rows(spark):
    df = metric_rows(spark, [("train", 1, 0, "loss", 1.0), ("train", 1, 1, "loss", 2.0)])
    assert mt.reduce_over_workers(df, 4).first()["value"] == 0.75
    assert mt.reduce_over_workers(df, 4, average=False).first()["value"] == 3.0
    assert mt.reduce_over_workers(df, 1).count() == 2


def test_unknown_reduction(spark):
    df = metric_rows(spark, [("train", 1, 0, "loss", 1.0)])
    with pytest.raises(ValueError, match="median"):
        mt.aggregate_scalars(df, "median", 2)


def test_gather_is_in_rank_order(spark):
    df = metric_rows(spark, [("train", 1, r, "loss", float(r)) for r in (2, 0, 1)])
    workers = mt.gather(df).first()["workers"]
    assert [(w["rank"], w["metrics"]) for w in workers] == [(r, {"loss": float(r)}) for r in range(3)]


def test_best_takes_the_first_epoch_on_ties(spark):
    df = series(spark, [0.5, 0.9, 0.9, 0.1, 0.1])
    assert tuple(mt.best(df).first())[2:] == (0.9, 2)
    assert tuple(mt.best(df, "min").first())[2:] == (0.1, 4)
    with pytest.raises(ValueError):
        mt.best(df, "median")


def test_history_comes_in_pages_when_asked(spark):
    values = series(spark, [1.0, 2.0, 3.0, 4.0])
    assert [(p["page"], p["values"]) for p in mt.history(values).collect()] == [(0, [1.0, 2.0, 3.0, 4.0])]
    pages = mt.history(values, page_epochs=3).collect()
    assert [(p["page"], p["values"]) for p in pages] == [(0, [1.0, 2.0, 3.0]), (1, [4.0])]


def test_average_of_last(spark):
    df = series(spark, [1.0, 2.0, 4.0])
    asked = [("train", "loss"), ("val", "loss")]
    got = {r["phase"]: r["average"] for r in mt.average_of_last(df, asked, 2).collect()}
    assert got == {"train": 3.0, "val": 0.0}


def test_snapshot_with_times(spark):
    df = series(spark, [1.0, 2.0]).unionByName(series(spark, [5.0], "val"))
    times = local_table(spark, [{"total": 3.0}], "total double")
    row = mt.snapshot(df, times).first()
    assert row["metrics_history"] == {"train": {"loss": [1.0, 2.0]}, "val": {"loss": [5.0]}}
    assert (row["current_epoch"], row["total"]) == (2, 3.0)


def test_array_metric_is_compared_by_mean(spark):
    df = spark.sql("SELECT 'train' AS phase, 'f' AS name, e AS epoch, IF(e = 1, array(1.0D, 5.0D), array(4.0D)) AS values FROM VALUES (1), (2) AS t(e)")
    assert tuple(mt.best(df.withColumn("value", mt.scalar(F.col("values")))).first())[2:] == (4.0, 2)


def events(spark, *rows):
    return local_table(
        spark,
        [{"name": n, "kind": k, "ts_us": t, "seq": i} for i, (n, k, t) in enumerate(rows)],
        "name string, kind string, ts_us bigint, seq bigint",
    )


HOUR = 3_600_000_000


def test_timer_rules(spark):
    df = events(
        spark,
        ("a", "end", 1),
        ("a", "start", 5),
        ("a", "start", 7),
        ("a", "end", 10),
        ("a", "end", 12),
        ("b", "start", 0),
        ("b", "end", 5 * HOUR),
        ("c", "start", 1),
    )
    pairs, unmatched = tm.pair_timers(df)
    got = sorted((r["name"], r["start_us"], r["end_us"]) for r in pairs.collect())
    assert got == [("a", 7, 10), ("b", 0, 5 * HOUR)]
    assert sorted(r["ts_us"] for r in unmatched.collect()) == [1, 12]
    looked_up = {r["name"]: r["total_time"] for r in tm.timer_lookup(pairs, ["a", "zz"]).collect()}
    assert looked_up == {"a": 3e-6, "zz": 0.0}


@pytest.mark.parametrize("tasks", [1, 3, 16])
@pytest.mark.parametrize("spread", [400, 1])
def test_a_hot_name_spreads_over_tasks(spark, tasks, spread):
    rows = [("hot" if i % 10 else None if i % 20 else "cold", "end" if (i * 7) % 5 < 2 else "start", (i * 37) % spread) for i in range(600)]
    before, want = {}, []
    for seq, (name, kind, ts) in sorted(enumerate(rows), key=lambda r: (r[1][2], r[0])):
        kind_before, ts_before = before.get(name, (None, 0))
        if kind == "end" and kind_before == "start":
            want.append((name, seq, ts_before, ts, ts - ts_before))
        before[name] = (kind, ts)
    spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ordered = with_previous_scan(events(spark, *rows), ["name"], ["ts_us", "seq"], ["kind", "ts_us"])
        got = [tuple(r) for r in tm.pair_timers(events(spark, *rows))[0].collect()]
        assert ordered.columns == ["name", "kind", "ts_us", "seq", "prev"] and ordered.count() == len(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(got, key=str) == sorted(want, key=str)
    assert len(want) > 20


def test_previous_scan_of_an_empty_table(spark):
    assert with_previous_scan(events(spark, ("a", "start", 1)).where("false"), ["name"], ["ts_us"], ["kind"]).count() == 0


def test_epoch_times(spark):
    df = events(spark, ("run", "start", 0), ("run", "end", 2_000_000), ("run", "end", 3_000_000), ("run", "start", 4_000_000))
    row = tm.epoch_times(df).first()
    assert (row["current_epoch"], row["epochs_completed"], row["total_epoch_time"]) == (2, 1, 2.0)
