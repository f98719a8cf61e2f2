import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidelog.operators import quantiles as qt
from tidelog.operators import stats as st
from tidelog.operators.timing import batch_timing
from tidelog.session import local_table

NAMES = ["none", "one", "two", "many"]


def samples(spark, **series):
    rows = [
        {"experiment": name, "i": i, "seconds": float(s)} for name, values in series.items() for i, s in enumerate(values)
    ]
    return local_table(spark, rows, "experiment string, i bigint, seconds double")


@pytest.fixture(scope="module")
def timing(spark):
    return samples(spark, one=[3.0], two=[1.0, 2.0], many=[1, 2, 3, 4, 5, 6, 7, 8, 9, 100, -100], other=[1.0])


def test_one_point(spark, timing):
    row = st.boxplot_stats(timing, NAMES).where("experiment = 'one'").first()
    assert (row["q1"], row["median"], row["q3"], row["std_dev"], row["variance"]) == (3.0, 3.0, 3.0, 0.0, 0.0)


def test_statistics_equal_numpy(timing):
    row = st.boxplot_stats(timing, NAMES).where("experiment = 'many'").first()
    data = np.array([1, 2, 3, 4, 5, 6, 7, 8, 9, 100, -100], dtype=float)
    for name, want in {
        "q1": np.percentile(data, 25),
        "median": np.median(data),
        "q3": np.percentile(data, 75),
        "variance": np.var(data, ddof=1),
        "std_dev": np.std(data, ddof=1),
        "min": data.min(),
        "max": data.max(),
    }.items():
        assert row[name] == pytest.approx(want, abs=1e-12)
    assert row["count"] == 11


def test_analysis_lists_every_name(timing):
    rows = {r["experiment"]: r for r in st.analyze(timing, NAMES, ["i"]).collect()}
    assert set(rows) == set(NAMES)
    assert rows["none"]["count"] is None and rows["none"]["n_lower"] is None
    assert (rows["many"]["lower_outliers"], rows["many"]["upper_outliers"]) == ([-100.0], [100.0])
    assert (rows["two"]["n_lower"], rows["two"]["n_upper"]) == (0, 0)


def test_shown_outliers_are_limited_but_all_counted(spark):
    many = samples(spark, a=[1.0] * 100 + [50.0 + i for i in range(9)])
    row = st.analyze(many, ["a"], ["i"]).first()
    assert row["n_upper"] == 9
    assert row["upper_outliers"] == [50.0, 51.0, 52.0, 53.0, 54.0]
    assert st.outliers(many, st.boxplot_stats(many)).count() == 9


@pytest.mark.parametrize("ties", [False, True])
@pytest.mark.parametrize("bins", [3, 64])
def test_narrowed_quantiles_are_exact(spark, ties, bins):
    """A long-tailed group far beyond the bracket size, in one case with a third of its rows on one value."""
    rng = np.random.default_rng(7)
    values = np.concatenate([rng.lognormal(sigma=2, size=20_000), [1e300, -1e300]])
    if ties:
        values[rng.random(values.size) < 0.35] = float(np.median(values))
    frame = spark.createDataFrame(
        pd.DataFrame({"g": ["hot"] * values.size + ["few"] * 11, "v": np.concatenate([values, values[:11]])})
    )
    probs = [0.0, 0.25, 0.5, 0.75, 0.999]
    ranges = frame.groupBy("g").agg(*qt.range_columns(F.col("v")))
    rows = qt.exact_quantiles(frame, "g", "v", probs, ranges, bracket_rows=500, bins=bins).collect()
    got = {r["g"]: r["q"] for r in rows}
    assert got["hot"] == pytest.approx([np.quantile(values, p) for p in probs], rel=1e-12)
    assert got["few"] == pytest.approx([np.quantile(values[:11], p) for p in probs], rel=1e-12)


def test_ranks_on_both_sides_of_a_gap(spark):
    values = [0.0] * 300 + [0.001 * i for i in range(200)] + [1000.0 - 0.001 * i for i in range(500)]
    frame = spark.createDataFrame(pd.DataFrame({"g": ["g"] * len(values), "v": values}))
    ranges = frame.groupBy("g").agg(*qt.range_columns(F.col("v")))
    got = qt.exact_quantiles(frame, "g", "v", [0.5], ranges, bracket_rows=20, bins=8).first()["q"]
    assert got == pytest.approx([np.median(values)])


def test_ordinals(spark):
    numbers = [1, 2, 3, 4, 11, 12, 13, 21, 111, 112]
    df = local_table(spark, [{"n": n} for n in numbers], "n int").select("n", st.ordinal_suffix(F.col("n")).alias("s"))
    got = {r["n"]: r["s"] for r in df.collect()}
    assert [got[n] for n in numbers] == "st nd rd th th th th st th th".split()


def test_comparison(timing):
    means = st.experiment_means(timing, NAMES)
    assert [r["experiment"] for r in st.rank_experiments(means).orderBy("rank").collect()] == ["two", "one", "many"]
    ratios = {r["experiment"]: r for r in st.ratio_to_best(means).collect()}
    assert ratios["one"]["ratio"] == 2.0 and ratios["one"]["slowdown_pct"] == 100.0
    assert ratios["two"]["slowdown_pct"] is None
    row = st.spread(means).first()
    assert (row["best_performer"], row["worst_performer"]) == ("two", "many")
    assert st.spread(st.experiment_means(timing, ["none"])).count() == 0


def test_error_bars_have_both_deviations(timing):
    rows = {r["experiment"]: r for r in st.error_bars(timing, NAMES).collect()}
    assert set(rows) == {"one", "two", "many"}
    assert (rows["two"]["std_samp"], rows["two"]["std_pop"]) == (pytest.approx(0.5**0.5), 0.5)


def test_summary_reports_empty_names(timing):
    rows = {r["experiment"]: r for r in st.experiment_summary(timing, NAMES).collect()}
    assert rows["none"]["count"] == 0 and rows["none"]["avg"] is None
    assert rows["two"]["avg"] == 1.5


def test_batch_timing(spark):
    df = local_table(
        spark,
        [{"experiment": "a", "batch_id": i, "seconds": float(i + 1)} for i in range(4)],
        "experiment string, batch_id bigint, seconds double",
    )
    rows = {r["experiment"]: r for r in batch_timing(df, ["a", "b"]).collect()}
    assert (rows["a"]["num_batches"], rows["a"]["median_batch_time"], rows["a"]["total_time"]) == (4, 2.5, 10.0)
    assert (rows["b"]["num_batches"], rows["b"]["mean_batch_time"], rows["b"]["total_time"]) == (0, 0.0, 0.0)
    assert batch_timing(df, ["a"], 3).first()["num_batches"] == 3
    assert batch_timing(df, ["a"], 0).first()["num_batches"] == 4
