"""Bad, zero, null and large inputs."""

import math

import pytest
from pyspark.sql import functions as F

from tidelog.operators import assemble, metrics, quantiles, stats
from tidelog.operators.ordered import chunk_bucket, with_position, with_previous
from tidelog.operators.timing import batch_timing
from tidelog.schemas import Payload
from tidelog.session import local_table, small_table
from tidelog.sources.avro import _varint, decode_samples, encode_body
from tidelog.sources.decode import decode_json
from tidelog.sources.log import range_bounds

CLOSING = [
    '{"x":[1],"y":"a"}],"z":[1',
    '{"x":[1],"y":"a"}],"body":[{"x":[2]}',
    '{"x":[1],"y":"a"}},"again":{"body":{"x":[1]}',
    '{"x":[1],"y":"a"}]}',
    '{"x":[1],"y":"a"},{"x":[2],"y":"b"}',
    '{"x":[1],"y":"a"}} ',
    '{"x":[1],"y":"a"}],"again":{"body":1},"end":"0"}',
]


def test_bodies_that_close_their_wrapper_are_bad(spark):
    rows = [{"offset": i, "value": v} for i, v in enumerate([*CLOSING, '{"x":[1],"y":"a"}'])]
    got = decode_json(local_table(spark, rows, "offset bigint, value string"), Payload("none")).orderBy("offset").collect()
    assert [r["is_bad"] for r in got] == [True] * len(CLOSING) + [False]
    assert got[-1]["x"] == [1.0]


def test_numbers_beyond_32_bits_make_one_bad_row(spark):
    good = encode_body([1.0], [1], 3, "d", "s", 0)
    bad = encode_body([1.0], [1], 1 << 31, "d", "s", 0)
    got = decode_samples(spark.createDataFrame([(0, good), (1, bad)], "i int, value binary")).orderBy("i").collect()
    assert got[0]["sample"]["label"] == 3 and got[1]["sample"] is None
    assert _varint(1 << 31)


def test_null_keys_keep_their_rows(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), (None, 0), (None, 1)], "role string, i int")
    got = with_position(df, ["role"], ["i"], chunk_bucket(F.col("i").cast("bigint")), "pos", "n").collect()
    assert sorted((r["role"] or "", r["pos"], r["n"]) for r in got) == [("", 0, 2), ("", 1, 2), ("a", 0, 2), ("a", 1, 2)]
    got = with_previous(df, ["role"], ["i"], F.lit(0), ["i"]).where("i = 1").collect()
    assert {(r["role"], r["prev"]["i"]) for r in got} == {("a", 0), (None, 0)}


def test_zero_divisors_never_fail(spark):
    means = spark.createDataFrame([("a", 0.0), ("b", 2.0)], "experiment string, mean double")
    got = {r["experiment"]: r["ratio"] for r in stats.ratio_to_best(means).collect()}
    assert math.isnan(got["a"]) and got["b"] == float("inf")
    zero = means.where("mean = 0")
    assert math.isnan(stats.spread(zero).first()["relative_improvement"])
    times = spark.createDataFrame([("a", 0, 0.0)], "experiment string, batch_id int, seconds double")
    assert batch_timing(times, ["a"]).first()["batches_per_second"] == float("inf")
    empty = spark.createDataFrame([([],)], "v array<double>")
    assert math.isnan(empty.select(metrics.scalar(F.col("v")).alias("m")).first()["m"])


def test_quantiles_of_many_groups(spark, monkeypatch):
    df = spark.range(4000).select((F.col("id") % 7).alias("g"), ((F.col("id") * 7919) % 1013).cast("double").alias("v"))
    ranges = df.groupBy("g").agg(*quantiles.range_columns(F.col("v")))
    few = {r["g"]: r["q"] for r in quantiles.exact_quantiles(df, "g", "v", [0.1, 0.5, 0.99], ranges).collect()}
    monkeypatch.setattr(quantiles, "small_table", lambda x: small_table(x, 3))
    many = {r["g"]: r["q"] for r in quantiles.exact_quantiles(df, "g", "v", [0.1, 0.5, 0.99], ranges).collect()}
    assert len(many) == 7 and all(many[g] == pytest.approx(few[g]) for g in few)


def test_bounds_of_many_partitions_stay_exact(spark):
    rows = [{"partition": p, "start_offset": 10 * p, "end_offset": 10 * p + 3} for p in range(300)]
    log = spark.range(300 * 3000).select((F.col("id") % 300).cast("int").alias("partition"), F.expr("id div 300").alias("offset"))
    assert log.where(range_bounds(rows)).count() == 300 * 4


def test_loader_flag_beside_the_sampler(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("k"), F.lit("train").alias("role"))
    assert assemble.epoch_table(df, "k", 8, 3).count() == 3 * 32
    assert assemble.epoch_table(df, "k", 8, 3, drop_last=False).count() == 3 * 33
    assert assemble.loader_stats(df, 8, 3, ("train",)).first()["num_batches"] == 4
    assert assemble.loader_stats(df, 8, 3, ("train",), drop_last=False).first()["num_batches"] == 5
