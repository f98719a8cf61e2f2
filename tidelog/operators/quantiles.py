"""Exact quantiles per group without holding a group's values in one task.

Each wanted rank has a bracket of values, at first the group's whole range. While a bracket holds too many rows, a histogram
pass (counts per bin, combined before the shuffle) finds the bin with the rank, which becomes the new bracket. The
last pass orders only what is left in the brackets. The driver keeps a few numbers per group and rank.
"""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.operators.ordered import with_position
from tidelog.session import local_table, small_table

# Rows a bracket may hold before its values are ordered in one window.
BRACKET_ROWS = 1_000_000
BINS = 4096


def range_columns(value: Column) -> list[Column]:
    """Aggregates for the first pass, to be combined with any others over the same groups."""
    return [F.count(value).alias("_n"), F.min(value).alias("_min"), F.max(value).alias("_max")]


def _bracket_rows(df: DataFrame, key: str, value: str, brackets: dict) -> DataFrame:
    """Every row once per bracket of its group that holds its value."""
    schema = T.StructType(
        [
            df.schema[key],
            T.StructField(
                "_brackets",
                T.ArrayType(
                    T.StructType(
                        [
                            T.StructField("b", T.IntegerType()),
                            T.StructField("lo", T.DoubleType()),
                            T.StructField("hi", T.DoubleType()),
                            T.StructField("below", T.LongType()),
                        ]
                    )
                ),
            ),
        ]
    )
    by_group: dict = {}
    for (group, b), (lo, hi, below) in brackets.items():
        by_group.setdefault(group, []).append({"b": b, "lo": lo, "hi": hi, "below": below})
    marks = local_table(df.sparkSession, [{key: g, "_brackets": m} for g, m in by_group.items()], schema)
    v = F.col(value).cast("double")
    held = F.filter("_brackets", lambda m: (v >= m["lo"]) & (v <= m["hi"]))
    return df.select(key, value).join(marks, key).select(key, v.alias("_v"), F.explode(held).alias("_m"))


def _narrow(df: DataFrame, key: str, value: str, brackets: dict, targets: list[dict], bins: int) -> None:
    """Move the given targets to the histogram bin that holds their rank."""
    lo, hi = F.col("_m.lo") * 0.5, F.col("_m.hi") * 0.5
    place = F.floor((F.col("_v") * 0.5 - lo) / (hi - lo) * bins)
    rows = _bracket_rows(df, key, value, brackets)
    binned = rows.groupBy(key, F.col("_m.b").alias("b"), F.col("_m.below").alias("below"), place.alias("_bin")).agg(
        F.count(F.lit(1)).alias("c"), F.min("_v").alias("lo"), F.max("_v").alias("hi")
    )
    before = Window.partitionBy(key, "b").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    placed = binned.withColumn("below", F.col("below") + F.coalesce(F.sum("c").over(before), F.lit(0)))
    wanted = local_table(
        df.sparkSession,
        [{key: t["group"], "b": t["b"], "rank": t["rank"]} for t in targets],
        T.StructType([df.schema[key], T.StructField("b", T.IntegerType()), T.StructField("rank", T.LongType())]),
    ).distinct()
    holds = (F.col("rank") >= F.col("below")) & (F.col("rank") < F.col("below") + F.col("c"))
    found = placed.join(wanted, [key, "b"]).where(holds).select(key, "b", "rank", "lo", "hi", "below", "c")
    at = {(r[key], r["b"], r["rank"]): r for r in found.collect()}
    for t in targets:
        r = at[t["group"], t["b"], t["rank"]]
        t.update(lo=r["lo"], hi=r["hi"], below=r["below"], rows=r["c"])


def _number(targets: list[dict]) -> dict:
    """Brackets by (group, number); targets with the same bounds share one."""
    seen: dict = {}
    for t in targets:
        bounds = (t["lo"], t["hi"], t["below"])
        numbers = seen.setdefault(t["group"], {})
        t["b"] = numbers.setdefault(bounds, len(numbers))
    return {(g, b): bounds for g, numbers in seen.items() for bounds, b in numbers.items()}


def _by_position(df: DataFrame, key: str, value: str, probs: list[float], ranges: DataFrame, bins: int) -> DataFrame:
    """Quantiles from the positions of rows, numbered bin by bin of their group's value range."""
    v, lo, hi = F.col("_v") * 0.5, F.col("_min") * 0.5, F.col("_max") * 0.5
    rows = df.select(key, F.col(value).cast("double").alias("_v")).where("_v is not null")
    rows = rows.join(ranges.select(key, "_n", F.col("_min").cast("double"), F.col("_max").cast("double")), key)
    bin_of = F.when(F.col("_max") > F.col("_min"), F.floor((v - lo) / (hi - lo) * bins)).otherwise(F.lit(0))
    placed = with_position(rows, [key], ["_v"], bin_of, "_pos", "_all")
    picks = []
    for i, p in enumerate(probs):
        h = (F.col("_n") - 1) * F.lit(p)
        for end, rank in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            picks.append(F.max(F.when(F.col("_pos") == rank, F.col("_v"))).alias(f"s{2 * i + (end == 'hi')}"))
    found = placed.groupBy(key).agg(F.max("_n").alias("_n"), *picks)
    quantiles = []
    for i, p in enumerate(probs):
        h = (F.col("_n") - 1) * F.lit(p)
        low, high = F.col(f"s{2 * i}"), F.col(f"s{2 * i + 1}")
        quantiles.append(low + (high - low) * (h - F.floor(h)))
    return found.select(key, F.array(*quantiles).alias("q"))


def exact_quantiles(
    df: DataFrame,
    key: str,
    value: str,
    probs: list[float],
    ranges: DataFrame,
    bracket_rows: int = BRACKET_ROWS,
    bins: int = BINS,
) -> DataFrame:
    """One row per group with `q` = array of linearly interpolated quantiles.

    `ranges` holds `range_columns` per group. Brackets of few groups are narrowed from the driver; of any number of groups, rows are
    numbered inside value bins of their group instead. The quantiles are the same.
    """
    _, groups = small_table(ranges.select(key, "_n", "_min", "_max").where("_n > 0"))
    if groups is None:
        return _by_position(df, key, value, probs, ranges, bins)
    targets = []
    for g in groups:
        for i, p in enumerate(probs):
            h = (g["_n"] - 1) * p
            for end, rank in (("lo", floor(h)), ("hi", ceil(h))):
                targets.append(
                    {
                        "group": g[key],
                        "slot": 2 * i + (end == "hi"),
                        "rank": rank,
                        "lo": float(g["_min"]),
                        "hi": float(g["_max"]),
                        "below": 0,
                        "rows": g["_n"],
                    }
                )
    # A pass divides a bracket's range by the number of bins, so this ends; equal values need no ordering.
    while True:
        brackets = _number(targets)
        wide = [t for t in targets if t["rows"] > bracket_rows and t["lo"] < t["hi"]]
        if not wide:
            break
        used = {(t["group"], t["b"]) for t in wide}
        _narrow(df, key, value, {k: m for k, m in brackets.items() if k in used}, wide, bins)
    spark = df.sparkSession
    rows = _bracket_rows(df, key, value, brackets)
    counted = rows.groupBy(key, F.col("_m.b").alias("b"), F.col("_m.below").alias("below"), "_v").agg(
        F.count(F.lit(1)).alias("c")
    )
    in_order = Window.partitionBy(key, "b").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.withColumn("upto", F.col("below") + F.sum("c").over(in_order))
    wanted = local_table(
        spark,
        [{key: t["group"], "b": t["b"], "slot": t["slot"], "rank": t["rank"]} for t in targets],
        T.StructType(
            [
                df.schema[key],
                T.StructField("b", T.IntegerType()),
                T.StructField("slot", T.IntegerType()),
                T.StructField("rank", T.LongType()),
            ]
        ),
    )
    hit = (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("c"))
    picked = (
        ranked.join(wanted, [key, "b"])
        .where(hit)
        .groupBy(key)
        .agg(*[F.max(F.when(F.col("slot") == s, F.col("_v"))).alias(f"s{s}") for s in range(2 * len(probs))])
    )
    sizes = local_table(
        spark,
        [{key: g[key], "_n": g["_n"]} for g in groups],
        T.StructType([df.schema[key], T.StructField("_n", T.LongType())]),
    )
    quantiles = []
    for i, p in enumerate(probs):
        h = (F.col("_n") - 1) * F.lit(p)
        lo, hi = F.col(f"s{2 * i}"), F.col(f"s{2 * i + 1}")
        quantiles.append(lo + (hi - lo) * (h - F.floor(h)))
    return picked.join(sizes, key).select(key, F.array(*quantiles).alias("q"))
