import json
import random

import pytest
from pyspark.sql import functions as F

import tidelog.sources.log as log_module
from conftest import plan_text
from tidelog.catalog import views as v
from tidelog.plans.splits import offset_strings, parse_offsets, plan_splits
from tidelog.schemas import Payload
from tidelog.session import local_table, small_table
from tidelog.sources.avro import decode_body, encode_body
from tidelog.sources.decode import dead_letter, decode, decode_json, strict_prefix
from tidelog.sources.log import kafka_offset_options, range_bounds, read_parquet_log, read_ranges

JSON = Payload("none")


@pytest.fixture(scope="module")
def parquet_log(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("log") / "log")
    v.message_log(spark, sf_dir).write.parquet(path)
    return path


def test_ranges_are_pushed_into_the_scan(spark, parquet_log):
    plan = plan_splits(parse_offsets(offset_strings(spark, ["0:5:9", "2:7:12"])), None)
    df = read_ranges(read_parquet_log(spark, parquet_log), plan).select("partition", "offset", "split_idx")
    text = plan_text(df)
    pushed = [line for line in text.splitlines() if "PushedFilters" in line or "DataFilters" in line]
    assert any("GreaterThanOrEqual(offset,5)" in line or "offset" in line for line in pushed)
    assert "BroadcastHashJoin" in text
    # Bodies are not read for a query that does not need them.
    assert all("value" not in line.split("ReadSchema")[-1] for line in text.splitlines() if "ReadSchema" in line)
    got = sorted((r["partition"], r["offset"]) for r in df.collect())
    assert got == [(0, o) for o in range(5, 10)] + [(2, o) for o in range(7, 13)]


def test_a_plan_beyond_the_limit_joins_by_shuffle(spark, parquet_log, monkeypatch):
    log = read_parquet_log(spark, parquet_log)
    plan = plan_splits(parse_offsets(offset_strings(spark, [f"{p}:3:40" for p in range(4)])), [{"rate": 0.5}])
    want = sorted(map(tuple, read_ranges(log, plan).select("split_idx", "partition", "offset").collect()))
    monkeypatch.setattr(log_module, "broadcast_limit", lambda spark: 2 * log_module.RANGE_BYTES)
    got = sorted(map(tuple, read_ranges(log, plan).select("split_idx", "partition", "offset").collect()))
    assert got == want


def test_many_ranges_of_one_partition_meet_in_cells(spark):
    draw = random.Random(4)
    spans = [(a, a + draw.choice([0, 1, 3, 9, 40, 2500])) for a in (draw.randint(-50, 3000) for _ in range(400))]
    plan = local_table(spark, [{"split_idx": i, "partition": i % 2 and 7, "start_offset": a, "end_offset": b} for i, (a, b) in enumerate(spans)], "split_idx int, partition int, start_offset bigint, end_offset bigint")
    log = spark.range(-100, 6000, 3).select(F.col("id").alias("offset"), F.lit(7).alias("partition"))
    got = sorted((r["split_idx"], r["offset"]) for r in read_ranges(log, plan).collect())
    assert got == sorted((i, o) for i, (a, b) in enumerate(spans) if i % 2 for o in range(-100, 6000, 3) if a <= o <= b)
    leveled = plan.withColumn("_level", F.length(F.conv(F.col("end_offset") - F.col("start_offset"), 10, 2)))
    assert 1 < len(log_module.cell_levels(leveled)) < 6


def test_many_partitions_keep_their_own_bounds(spark):
    rows = [{"partition": p, "start_offset": p, "end_offset": p + 5} for p in range(300)]
    df = spark.range(10).select(F.lit(0).alias("partition"), F.col("id").alias("offset"))
    assert df.where(range_bounds(rows)).count() == 6
    assert df.where(range_bounds(rows[:3])).count() == 6
    assert df.where(range_bounds([])).count() == 0


def test_kafka_ends_are_exclusive():
    options = kafka_offset_options("t", {0: (5, 9)})
    assert json.loads(options["startingOffsets"]) == {"t": {"0": 5}}
    assert json.loads(options["endingOffsets"]) == {"t": {"0": 10}}


@pytest.mark.parametrize(
    "body, bad",
    [
        ('{"x":[1,2],"y":"a"}', False),
        ('{"y":"a"}', False),
        ('{"x":[1,2],"y":"a"} trailing', True),
        ('{"x":[1]},{"x":[2]}', True),
        ('{"x":', True),
        ("null", True),
        ("[1]", True),
        ("", True),
        ("{'x':[1]}", True),
        (None, True),
    ],
)
def test_json_bodies(spark, body, bad):
    df = local_table(spark, [{"value": body.encode() if body is not None else None}], "value binary")
    assert decode_json(df, JSON).first()["is_bad"] is bad


def test_payload_rules():
    with pytest.raises(ValueError, match="protobuf"):
        Payload("protobuf")
    default = Payload.default()
    assert (default.message_format, default.data_field, default.label_field) == ("none", "data", "label")
    assert Payload().message_format == "avro"


def bad_range_log(spark):
    bodies = {(0, o): '{"x":[1],"y":"a"}' for o in range(6)} | {(1, o): '{"x":[1],"y":"b"}' for o in range(4)}
    bodies[(0, 3)] = '{"x'
    rows = [{"partition": p, "offset": o, "value": b.encode()} for (p, o), b in bodies.items()]
    return local_table(spark, rows, "partition int, offset bigint, value binary")


def test_strict_prefix_and_dead_letter(spark):
    plan = plan_splits(parse_offsets(offset_strings(spark, ["0:0:5", "1:0:3"])), None)
    decoded = decode(read_ranges(bad_range_log(spark), plan), JSON)
    kept = sorted((r["partition"], r["offset"]) for r in strict_prefix(decoded).collect())
    assert kept == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2), (1, 3)]
    good, bad = dead_letter(decoded)
    assert good.count() == 9
    assert [(r["partition"], r["offset"]) for r in bad.collect()] == [(0, 3)]


def test_record_bodies():
    body = encode_body([1.5, -2.0], [1, 2], -3, "d", "train", 70000)
    record = decode_body(body)
    assert list(record["data"]) == [1.5, -2.0]
    assert record["shape"] == [1, 2]
    assert (record["label"], record["meta"]) == (-3, {"dataset": "d", "split": "train", "index": 70000})
    # An array may come in several blocks, and a block may carry its size in bytes.
    sized = bytes([0x01, 0x08]) + body[1:5] + bytes([0x02]) + body[5:9] + bytes([0x00]) + body[10:]
    assert list(decode_body(sized)["data"]) == [1.5, -2.0]
    with pytest.raises((IndexError, ValueError)):
        decode_body(body[:6])
    assert list(decode_body(encode_body([], [], 0, "", "", 0))["data"]) == []
