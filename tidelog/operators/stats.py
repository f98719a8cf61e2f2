"""Statistics over timing samples: quartiles, fences, outliers, rankings, comparisons.

Experiments are named by the caller, as the reports list fixed names: samples of other names are left out and a name
without samples gives a null row. Without a list of names, every name counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.lets import ratio
from tidelog.operators.quantiles import exact_quantiles, range_columns
from tidelog.session import local_table, small_table

QUARTILES = [0.25, 0.5, 0.75]


def _named(df: DataFrame, names: list[str] | None, key: str) -> DataFrame:
    if names is None:
        return df.where(F.col(key).isNotNull())
    return df.where(F.col(key).isin(*names)) if names else df.where(F.lit(False))


def name_table(df: DataFrame, names: list[str], key: str = "experiment") -> DataFrame:
    rows = [{"name_pos": i, key: n} for i, n in enumerate(names)]
    return local_table(df.sparkSession, rows, f"name_pos int, {key} string")


def boxplot_stats(
    df: DataFrame, names: list[str] | None = None, key: str = "experiment", value: str = "seconds"
) -> DataFrame:
    """Count, quartiles, iqr, fences, mean, sample variance and deviation, min and max; no row for an empty name."""
    rows = _named(df, names, key)
    v = F.col(value)
    base = rows.groupBy(key).agg(
        *range_columns(v),
        F.avg(v).alias("mean"),
        F.coalesce(F.var_samp(v), F.lit(0.0)).alias("variance"),
        F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std_dev"),
    ).where("_n > 0")
    # At most one row per name: checked, and read from here on without another pass over the samples.
    base, _ = small_table(base)
    quantiles = exact_quantiles(rows, key, value, QUARTILES, base)
    q1, q3 = F.col("q")[0], F.col("q")[2]
    iqr = q3 - q1
    return base.join(quantiles, key).select(
        key,
        F.col("_n").alias("count"),
        q1.alias("q1"),
        F.col("q")[1].alias("median"),
        q3.alias("q3"),
        iqr.alias("iqr"),
        (q1 - iqr * 1.5).alias("lower_fence"),
        (q3 + iqr * 1.5).alias("upper_fence"),
        "mean",
        "variance",
        "std_dev",
        F.col("_min").alias("min"),
        F.col("_max").alias("max"),
    )


def outliers(
    df: DataFrame, stats: DataFrame, key: str = "experiment", value: str = "seconds"
) -> DataFrame:
    """Every sample strictly outside its experiment's fences, with the `side`; one row each, none left out.

    `stats` has at most one row per named experiment; its size is checked and it joins as a local relation.
    """
    fences, _ = small_table(stats.select(key, "lower_fence", "upper_fence"))
    side = F.when(F.col(value) < F.col("lower_fence"), "lower").when(F.col(value) > F.col("upper_fence"), "upper")
    return (
        df.join(fences, key)
        .withColumn("side", side)
        .where(F.col("side").isNotNull())
        .drop("lower_fence", "upper_fence")
    )


def analyze(
    df: DataFrame,
    names: list[str],
    order: list[str],
    key: str = "experiment",
    value: str = "seconds",
    shown: int = 5,
) -> DataFrame:
    """Statistics for every name, null for an empty one, with outlier counts and the first few outliers for display."""
    stats, _ = small_table(boxplot_stats(df, names, key, value))
    found = outliers(_named(df, names, key), stats, key, value)
    counts = found.groupBy(key).agg(
        F.count_if(F.col("side") == "lower").alias("n_lower"),
        F.count_if(F.col("side") == "upper").alias("n_upper"),
    )
    # The rank limit is applied before the shuffle, so a task holds a few rows per side.
    first = Window.partitionBy(key, "side").orderBy(*order)
    examples = (
        found.withColumn("_r", F.row_number().over(first))
        .where(F.col("_r") <= shown)
        .groupBy(key)
        .agg(*[_examples(side, value) for side in ("lower", "upper")])
    )
    return (
        name_table(df, names, key)
        .join(stats, key, "left")
        .join(counts, key, "left")
        .join(examples, key, "left")
        .withColumn("n_lower", F.when(F.col("count").isNotNull(), F.coalesce("n_lower", F.lit(0))))
        .withColumn("n_upper", F.when(F.col("count").isNotNull(), F.coalesce("n_upper", F.lit(0))))
        .drop("name_pos")
    )


def _examples(side: str, value: str) -> Column:
    picked = F.collect_list(F.when(F.col("side") == side, F.struct("_r", value)))
    return F.transform(F.sort_array(picked), lambda s: s[value]).alias(f"{side}_outliers")


def experiment_means(df: DataFrame, names: list[str], key: str = "experiment", value: str = "seconds") -> DataFrame:
    """One row per named experiment that has samples."""
    return _named(df, names, key).groupBy(key).agg(F.avg(value).alias("mean")).where(F.col("mean").isNotNull())


def ordinal_suffix(n: Column) -> Column:
    teens = (n % 100).between(10, 20)
    last = n % 10
    return (
        F.when(teens, "th").when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd").otherwise("th")
    )


def rank_experiments(means: DataFrame, key: str = "experiment") -> DataFrame:
    """Rank by ascending mean, ties by name. `means` holds one row per experiment."""
    place = F.row_number().over(Window.orderBy("mean", key))
    return means.withColumn("rank", place).withColumn("rank_suffix", ordinal_suffix(F.col("rank")))


def ratio_to_best(means: DataFrame) -> DataFrame:
    """Each mean over the best one; infinite or not-a-number where the best is 0."""
    best = F.min("mean").over(Window.partitionBy(F.lit(0)))
    return means.withColumn("ratio", ratio(F.col("mean"), best)).withColumn(
        "slowdown_pct", F.when(F.col("ratio") > 1, (F.col("ratio") - 1) * 100)
    )


def spread(means: DataFrame, key: str = "experiment") -> DataFrame:
    """Best, worst, their distance, and the improvement relative to the worst."""
    ends = means.agg(
        F.min(F.struct("mean", key)).alias("best"), F.max(F.struct("mean", key)).alias("worst")
    ).where(F.col("best").isNotNull())
    gap = F.col("worst.mean") - F.col("best.mean")
    return ends.select(
        F.col(f"best.{key}").alias("best_performer"),
        F.col(f"worst.{key}").alias("worst_performer"),
        gap.alias("performance_spread"),
        (ratio(gap, F.col("worst.mean")) * 100).alias("relative_improvement"),
    )


def error_bars(df: DataFrame, names: list[str], key: str = "experiment", value: str = "seconds") -> DataFrame:
    """Mean with sample and population deviation; names without samples are dropped."""
    return (
        _named(df, names, key)
        .groupBy(key)
        .agg(
            F.avg(value).alias("mean"),
            F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std_samp"),
            F.stddev_pop(value).alias("std_pop"),
        )
        .where(F.col("mean").isNotNull())
    )


def experiment_summary(df: DataFrame, names: list[str], key: str = "experiment", value: str = "seconds") -> DataFrame:
    """Count, average, min and max per name; count 0 and nulls for a name without samples."""
    found = _named(df, names, key).groupBy(key).agg(
        F.count(value).alias("count"), F.avg(value).alias("avg"), F.min(value).alias("min"), F.max(value).alias("max")
    )
    return (
        name_table(df, names, key)
        .join(found, key, "left")
        .select(key, F.coalesce("count", F.lit(0)).alias("count"), "avg", "min", "max")
    )


def pool(df: DataFrame, names: list[str], key: str = "experiment") -> DataFrame:
    """All ranks' samples of all iterations under the fixed names; other names are dropped."""
    return _named(df, names, key)
