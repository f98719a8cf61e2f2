import random

import pytest
from pyspark.sql import functions as F

from tidelog.plans.splits import (
    Split,
    malformed_offsets,
    normalize_splits,
    offset_distribution,
    offset_strings,
    parse_offsets,
    partition_worker_check,
    plan_splits,
    split_report,
)
from tidelog.session import local_table

# The offsets in these tests must come out exactly so.
THREE = [{"rate": 0.85715}, {"rate": 0.071425}, {"rate": 0.071425}]


def ranges(spark, texts, splits, mode="compat"):
    plan = plan_splits(parse_offsets(offset_strings(spark, texts)), splits, mode)
    return [tuple(r) for r in split_report(plan).select("split_idx", "partition", "start_offset", "end_offset").collect()]


def test_three_splits(spark):
    assert ranges(spark, ["0:0:19999"], THREE) == [(0, 0, 0, 17141), (1, 0, 17142, 18570), (2, 0, 18571, 19999)]


def test_half_split(spark):
    got = ranges(spark, ["2:0:5833", "11:0:5832", "0:0:5833"], [{"rate": 0.5}, {"rate": 0.5}])
    assert (0, 2, 0, 2916) in got
    assert (0, 11, 0, 2916) in got
    assert (1, 2, 2917, 5833) in got


def test_rounds_half_to_even(spark):
    assert ranges(spark, ["0:0:6"], [{"rate": 0.5}, {"rate": 0.5}])[0] == (0, 0, 0, 2)


def test_width_is_at_least_one(spark):
    assert ranges(spark, ["0:0:4"], [{"rate": 0.01}, {"rate": 0.99}])[0] == (0, 0, 0, 1)


def test_exhausted_partition_overlaps_or_is_empty(spark):
    half = [{"rate": 0.5}, {"rate": 0.5}]
    assert ranges(spark, ["0:0:1"], half) == [(0, 0, 0, 1), (1, 0, 1, 1)]
    plan = plan_splits(parse_offsets(offset_strings(spark, ["0:0:1"])), half, "disjoint")
    assert [r["is_empty"] for r in plan.orderBy("split_idx").collect()] == [False, True]


def test_fillup_uses_the_widest_partition(spark):
    texts = ["0:0:99", "1:0:9"]
    with_fillup = ranges(spark, texts, [{"rate": 0.5}, {"rate": 0.5}])
    without = ranges(spark, texts, [{"rate": 0.5, "fillup": False}, {"rate": 0.5}])
    assert (0, 1, 0, 9) in with_fillup
    assert (0, 1, 0, 4) in without


@pytest.mark.parametrize(
    "given, rates",
    [
        (None, [1.0]),
        ([], [1.0]),
        ([{"rate": 0.6}, {}], [0.6, 0.4]),
        ([{"rate": 0.6}], [0.6, 0.4]),
        ([{"rate": 0.6}, {"rate": None, "fillup": False}], [0.6, 0.4]),
        (THREE, [0.85715, 0.071425, 0.071425]),
    ],
)
def test_split_rules(given, rates):
    assert [s.rate for s in normalize_splits(given)] == rates


@pytest.mark.parametrize("given", [[{"rate": 0.7}, {"rate": 0.7}, {"rate": 0.1}], [{}, {"rate": 0.5}], [{"rate": 1.2}]])
def test_split_rule_errors(given):
    with pytest.raises(ValueError):
        normalize_splits(given)


def test_input_list_is_left_alone():
    given = [{"rate": 0.6}]
    normalize_splits(given)
    assert given == [{"rate": 0.6}]
    assert normalize_splits([Split(1.0)]) == [Split(1.0, True)]


def test_malformed_strings(spark):
    strings = offset_strings(spark, ["0:0:9", "1:5", "2:a:9", "3:0:9:1"])
    assert [r["partition"] for r in parse_offsets(strings).collect()] == [0]
    assert sorted(r["pos"] for r in malformed_offsets(strings).collect()) == [1, 2, 3]
    with pytest.raises(Exception, match="malformed offset string"):
        parse_offsets(strings, strict=True).collect()


def test_distribution_keeps_input_order(spark):
    row = offset_distribution(parse_offsets(offset_strings(spark, ["2:0:30", "0:0:10"])), 4).first()
    assert row["partition_sizes"] == [30, 10]
    assert (row["total_records"], row["avg_records_per_process"]) == (40, 10.0)


def test_worker_check(spark):
    log = local_table(spark, [{"partition": 0}, {"partition": 1}], "partition int")
    row = partition_worker_check(log, offset_strings(spark, ["0:0:1", "1:0:1", "2:0:1"]), 2).first()
    assert row["partitions_match"] and not row["strings_match"]
    with pytest.raises(Exception, match="2 partitions and 3 offset strings for 2 workers"):
        partition_worker_check(log, offset_strings(spark, ["0:0:1", "1:0:1", "2:0:1"]), 2, strict=True).collect()
    row = partition_worker_check(log, offset_strings(spark, ["0:0:1", "1:0:1"]), 2, strict=True).first()
    assert row["partitions_match"] and row["strings_match"]


@pytest.mark.parametrize(
    ("rates", "want"),
    [([0.6], [0.6, 0.4]), ([0.6, None], [0.6, 0.4]), ([None], [1.0]), ([0.1] * 10, [0.1] * 10), ([1.0], [1.0])],
)
def test_rates_are_completed(rates, want):
    assert [s.rate for s in normalize_splits([{"rate": r} for r in rates])] == want


@pytest.mark.parametrize("rates", [[None, 0.5], [0.7, 0.7, 0.1], [0.5, 0.6]])
def test_wrong_rates_are_refused(rates):
    with pytest.raises(ValueError):
        normalize_splits([{"rate": r} for r in rates])


def recurrence(offsets, splits):
    """The plan step by step, one split after the other."""
    config = normalize_splits(splits)
    state = [(p, s, e, e - s - 1) for p, s, e in offsets]
    out = []
    for k, split in enumerate(config):
        widths = [max(1, round(d * split.rate)) for _, _, _, d in state]
        if split.fillup:
            widths = [max(widths)] * len(widths)
        stops = [e if k == len(config) - 1 else min(s + w, e) for (_, s, e, _), w in zip(state, widths)]
        out += [(k, p, s, stop) for (p, s, _, _), stop in zip(state, stops)]
        state = [(p, min(stop + 1, e), e, d) for (p, _, e, d), stop in zip(state, stops)]
    return sorted(out)


def test_closed_form_equals_recurrence(spark):
    rng = random.Random(5)
    for _ in range(12):
        n = rng.randint(1, 4)
        cuts = sorted(rng.random() for _ in range(n - 1))
        rates = [round(b - a, 6) for a, b in zip([0.0, *cuts], [*cuts, 1.0])]
        rates[-1] = round(1 - sum(rates[:-1]), 6)
        splits = [{"rate": r, "fillup": rng.random() < 0.5} for r in rates]
        offsets = []
        for p in range(rng.randint(1, 6)):
            start = rng.randint(0, 50)
            offsets.append((p, start, start + rng.choice([0, 1, 2, 7, 40, 1000])))
        texts = [f"{p}:{s}:{e}" for p, s, e in offsets]
        assert ranges(spark, texts, splits) == recurrence(offsets, splits)


def test_disjoint_mode_covers_each_offset_once(spark):
    rng = random.Random(9)
    offsets = [(p, s, s + rng.choice([0, 1, 3, 20])) for p in range(12) for s in [rng.randint(0, 9)]]
    texts = [f"{p}:{s}:{e}" for p, s, e in offsets]
    plan = plan_splits(parse_offsets(offset_strings(spark, texts)), [{"rate": 0.4}, {"rate": 0.3}, {"rate": 0.3}], "disjoint")
    hit = plan.where(~F.col("is_empty")).select("partition", F.explode(F.sequence("start_offset", "end_offset")).alias("o"))
    got = sorted((r["partition"], r["o"]) for r in hit.collect())
    assert got == [(p, o) for p, s, e in offsets for o in range(s, e + 1)]
