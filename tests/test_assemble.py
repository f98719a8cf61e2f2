import pytest
from pyspark.sql import functions as F

from conftest import plan_text
from tidelog.operators import assemble as asm
from tidelog.operators.assign import bootstrap_fillup, expand
from tidelog.operators.ordered import chunk_bucket, hash_bucket, with_position, with_previous
from tidelog.plans.splits import offset_strings, parse_offsets, plan_splits
from tidelog.session import local_table


def roles_table(spark, **sizes):
    rows = [{"role": r, "key": f"{r}-{i}"} for r, n in sizes.items() for i in range(n)]
    return local_table(spark, rows, "role string, key string")


def test_positions_are_a_permutation(spark):
    df = asm.role_positions(roles_table(spark, train=500, val=31), "key")
    by_role = {r["role"]: sorted(r["p"]) for r in df.groupBy("role").agg(F.collect_list("pos").alias("p")).collect()}
    assert by_role == {"train": list(range(500)), "val": list(range(31))}


def test_order_repeats_and_changes_by_epoch(spark):
    base = roles_table(spark, train=200)

    def order(epoch):
        rows = asm.shuffled_positions(base, "key", 1, epoch).orderBy("pos").collect()
        return [r["key"] for r in rows]

    assert order(0) == order(0)
    assert order(0) != order(1)


def test_eval_order_ignores_seed_and_epoch(spark):
    base = roles_table(spark, val=50)

    def order(seed, epoch):
        return [r["key"] for r in asm.role_positions(base, "key", seed, epoch).orderBy("pos").collect()]

    assert order(1, 0) == order(2, 7)


def test_position_equals_one_window_with_a_hot_bucket(spark):
    # Most rows share one leading key; chunks of the dense offset still split them.
    df = spark.range(3000).select(
        F.when(F.col("id") < 2900, 0).otherwise(1).alias("partition"), F.col("id").alias("offset")
    )
    got = with_position(df, ["partition"], ["offset"], chunk_bucket("offset", 100))
    rows = got.collect()
    assert all(r["pos"] == (r["offset"] if r["partition"] == 0 else r["offset"] - 2900) for r in rows)
    assert {(r["partition"], r["n_total"]) for r in rows} == {(0, 2900), (1, 100)}


def test_rows_are_never_gathered_in_one_partition(spark):
    df = roles_table(spark, train=100)
    text = plan_text(asm.shuffled_positions(df.select("key"), "key", 1))
    # Only the bucket counts pass through a single partition.
    for line_no, line in enumerate(text.splitlines()):
        if "Exchange SinglePartition" in line:
            assert "HashAggregate" in text.splitlines()[line_no + 1]


def test_previous_row_across_buckets(spark):
    rows = [{"k": "a", "t": t} for t in (1, 2, 50, 51, 400)] + [{"k": "b", "t": 60}]
    df = local_table(spark, rows, "k string, t bigint")
    got = with_previous(df, ["k"], ["t"], chunk_bucket("t", 10), ["t"]).collect()
    prev = {(r["k"], r["t"]): (r["prev"]["t"] if r["prev"] else None) for r in got}
    assert prev == {("a", 1): None, ("a", 2): 1, ("a", 50): 2, ("a", 51): 50, ("a", 400): 51, ("b", 60): None}


@pytest.mark.parametrize("n, drop, per_shard", [(10, True, 2), (10, False, 3), (12, False, 3), (3, False, 1), (2, False, 1), (3, True, 0)])
def test_shards_have_equal_length(spark, n, drop, per_shard):
    placed = asm.role_positions(roles_table(spark, train=n), "key")
    rows = asm.shard(placed, 4, F.lit(drop)).collect()
    assert len(rows) == 4 * per_shard
    for shard in range(4):
        assert sorted(r["shard_pos"] for r in rows if r["shard"] == shard) == list(range(per_shard))
    for r in rows:
        assert r["slot"] % n == r["pos"]


def test_padding_repeats_the_first_rows(spark):
    placed = asm.role_positions(roles_table(spark, val=10), "key")
    rows = asm.shard(placed, 4, F.lit(False)).collect()
    twice = sorted(r["pos"] for r in rows if r["slot"] >= 10)
    assert twice == [0, 1]


def test_batches(spark):
    placed = asm.shard(asm.role_positions(roles_table(spark, val=10), "key"), 1, F.lit(False))
    kept = asm.batch_arrays(asm.batch(placed, 4), ["key"]).collect()
    assert sorted(len(r["samples"]) for r in kept) == [2, 4, 4]
    assert asm.batch(placed, 4, drop_last=True).count() == 8
    assert asm.per_worker_batch(192, 3) == 64
    assert asm.per_worker_batch(2, 3) == 1


def test_golden_batches_per_rank(spark):
    texts = [f"{p}:0:19999" for p in range(3)]
    splits = [{"rate": 0.85715}, {"rate": 0.071425}, {"rate": 0.071425}]
    plan = plan_splits(parse_offsets(offset_strings(spark, texts)), splits)
    rows = expand(plan, F.col("start_offset"), F.col("end_offset"), "offset")
    rows = rows.withColumn("role", asm.role_of(F.col("split_idx"), 3)).withColumn("rank", F.col("partition"))
    info = asm.batch_info(rows, 192, 3).collect()
    assert {(r["train_batches"], r["val_batches"], r["test_batches"]) for r in info} == {(268, 23, 23)}
    assert rows.count() == 60000


def test_roles(spark):
    for bad in (0, 4):
        with pytest.raises(ValueError):
            asm.role_of(F.lit(0), bad)


def test_missing_loader_is_null(spark):
    stats = {r["role"]: r for r in asm.loader_stats(roles_table(spark, train=10, val=5), 4).collect()}
    assert (stats["train"]["num_batches"], stats["val"]["num_batches"]) == (2, 2)
    assert stats["val"]["total_samples_per_epoch"] == 8
    assert stats["test"]["dataset_size"] is None


def fillup_case(spark, sizes, seed=0):
    texts = [f"{p}:0:{n - 1}" for p, n in enumerate(sizes)]
    plan = plan_splits(parse_offsets(offset_strings(spark, texts)), None)
    samples = expand(plan, F.col("start_offset"), F.col("end_offset"), "offset").select("split_idx", "partition", "offset")
    return bootstrap_fillup(samples, plan, None, seed), samples, plan


def test_fillup_reaches_the_widest_partition(spark):
    filled, _, _ = fillup_case(spark, [50, 7, 1])
    rows = filled.collect()
    for p, n in enumerate([50, 7, 1]):
        own = [r for r in rows if r["partition"] == p]
        assert len(own) == 50
        assert {r["offset"] for r in own if r["copy"] == 0} == set(range(n))
        assert all(r["offset"] < n for r in own)


def test_fillup_of_one_row_many_times(spark):
    filled, _, _ = fillup_case(spark, [150_000, 1])
    assert filled.where("partition = 1").count() == 150_000


def test_long_spans_are_spread_over_tasks(spark):
    one = local_table(spark, [{"k": 1, "n": 1_000_000}], "k int, n bigint")
    spans = expand(one, F.lit(1).cast("bigint"), F.col("n"), "i", spread=True)
    per_task = spans.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in per_task) == 1_000_000
    assert len(per_task) > 1


def test_fillup_without_rows_is_an_error(spark):
    _, samples, plan = fillup_case(spark, [5, 5])
    with pytest.raises(Exception, match="no rows to draw from"):
        bootstrap_fillup(samples.where("partition = 0"), plan, None).collect()


def test_fillup_only_when_the_last_split_asks(spark):
    _, samples, plan = fillup_case(spark, [9, 3])
    plain = bootstrap_fillup(samples, plan, [{"rate": 1.0, "fillup": False}])
    assert plain.count() == 12


def test_log_positions_put_copies_last(spark):
    filled, _, _ = fillup_case(spark, [30, 8])
    rows = filled.withColumn("role", F.lit("test")).withColumn("rank", F.col("partition"))
    placed = asm.log_positions(rows).where("rank = 1").orderBy("pos").collect()
    assert [r["pos"] for r in placed] == list(range(30))
    assert [r["offset"] for r in placed[:8]] == list(range(8))
    assert all(r["copy"] > 0 for r in placed[8:])


def test_hash_buckets_follow_the_order(spark):
    df = spark.range(2000).select(asm.digest(F.col("id")).alias("h")).withColumn("b", hash_bucket("h", 2))
    rows = df.orderBy("h").collect()
    assert [r["b"] for r in rows] == sorted(r["b"] for r in rows)


def test_rows_travel_once_and_without_digests(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("sample_key"))
    rows = plan_text(asm.shuffled_positions(df, "sample_key", seed=7)).split("BroadcastExchange")[0]
    above, exchange, below = rows.partition("Exchange ")
    assert exchange and "Exchange " not in below
    assert "md5" in above and "md5" not in below.split("\n", 1)[1]
