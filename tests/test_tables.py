"""Checkpoints, saved results, split tables, images, vectors, training, worker tasks."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import plan_text
from tidelog.functions import scores as sc
from tidelog.functions import vectors as vec
from tidelog.operators import checkpoints as ckpt
from tidelog.operators.timing import run_load_experiment
from tidelog.operators.train import FeedForward, evaluate, final_test, run_on_workers, score, train
from tidelog.session import local_table, shared_dir, small_table
from tidelog.sources.images import gray_bytes, read_images
from tidelog.sources.results import load_results, raw_by_name, save_results, try_load_results
from tidelog.sources.split_table import read_split, write_split_table

CKPT = "unique_key string, epoch int, saved_at bigint, offset bigint, params map<string, array<float>>"


def ckpt_rows(spark, *rows):
    return local_table(
        spark,
        [
            {"unique_key": k, "epoch": e, "saved_at": t, "offset": o, "params": [("w", [float(o)] * 3)]}
            for k, e, t, o in rows
        ],
        CKPT,
    )


@pytest.fixture(scope="module")
def log(spark):
    return ckpt_rows(
        spark,
        ("net_2024_01", 1, 10, 0),
        ("net_2024_03", 2, 20, 1),
        ("net_2024_02", 3, 30, 2),
        ("other_2025_01", 4, 5, 3),
        ("net_2024_01", 5, 40, 4),
    )


def test_load_latest(log):
    assert ckpt.load_latest(log, "net").first()["unique_key"] == "net_2024_03"
    assert ckpt.load_latest(log).first()["unique_key"] == "other_2025_01"
    assert ckpt.load_latest(log, "net", by="time").first()["epoch"] == 5
    assert ckpt.load_latest(log, "absent").count() == 0
    with pytest.raises(ValueError):
        ckpt.load_latest(log, by="size")


def test_load_first(log):
    assert ckpt.load_first(log, "net_2024_01").first()["epoch"] == 1
    assert ckpt.load_first(log, "net").count() == 0
    with pytest.raises(ValueError):
        ckpt.load_first(log, "")


def test_retain_and_list(log):
    assert [r["offset"] for r in ckpt.list_checkpoints(log).collect()] == [4, 2, 1, 0, 3]
    assert sorted(r["offset"] for r in ckpt.retain_newest(log, 2).collect()) == [2, 4]
    assert ckpt.count_removed(log, 2).first()["removed"] == 3
    assert ckpt.count_removed(log).first()["removed"] == 0


def test_save_and_overwrite(spark, log, tmp_path):
    path = str(tmp_path / "ckpt")
    ckpt.save(log, path)
    ckpt.save(ckpt_rows(spark, ("net_2024_02", 9, 99, 5)), path)
    rows = {r["unique_key"]: r["epoch"] for r in ckpt.latest_per_key(spark.read.parquet(path)).collect()}
    assert rows == {"net_2024_01": 5, "net_2024_02": 9, "net_2024_03": 2, "other_2025_01": 4}
    # Winners are found on key columns: the first scan does not read parameters.
    text = plan_text(ckpt.load_first(spark.read.parquet(path), "net_2024_01"))
    schemas = [line.split("ReadSchema: ")[-1] for line in text.splitlines() if "ReadSchema" in line]
    assert any("params" not in s for s in schemas)


def test_retained_snapshot(spark, log, tmp_path):
    path = str(tmp_path / "snapshot")
    assert ckpt.write_retained(log, path, 3) == 2
    assert sorted(r["offset"] for r in spark.read.parquet(path).collect()) == [1, 2, 4]


def test_describe_lists_extras(spark):
    schema = CKPT + ", extra map<string, string>"
    row = {"unique_key": "k", "epoch": 1, "saved_at": 1, "offset": 1, "params": [("w", [1.0])]}
    rows = [{**row, "extra": [("lr", "0.1")]}, {**row, "extra": None}]
    got = [r["keys"] for r in ckpt.describe(local_table(spark, rows, schema)).collect()]
    assert got == [["model", "unique_key", "epoch", "lr"], ["model", "unique_key", "epoch"]]


def test_describe(log):
    row = ckpt.describe(log).first()
    assert (row["param_names"], row["model_parameters"], row["param_bytes"]) == (["w"], 3, 12)


TIMING = "experiment string, iteration int, rank int, seconds double"


def test_results_round_trip(spark, tmp_path):
    rows = [{"experiment": "a", "iteration": 0, "rank": r, "seconds": 1.0 + r} for r in range(3)]
    df = local_table(spark, rows, TIMING)
    path = str(tmp_path / "results")
    save_results(df, ["a", "b"], path)
    raw, stats = load_results(spark, path)
    assert raw.count() == 3
    by_name = {r["experiment"]: r for r in stats.collect()}
    assert by_name["a"]["median"] == 2.0 and by_name["b"]["count"] is None
    assert {r["experiment"]: r["n"] for r in raw_by_name(raw, ["a", "b"]).collect()} == {"a": 3, "b": 0}


def test_missing_or_malformed_results_are_none(spark, tmp_path):
    assert try_load_results(spark, str(tmp_path / "absent")) is None
    path = tmp_path / "broken"
    for part in ("raw_results", "statistical_analysis"):
        (path / part).mkdir(parents=True)
        (path / part / "part-0.json").write_text("{not json\n")
    assert try_load_results(spark, str(path)) is None


def test_split_table_is_pruned(spark, tmp_path):
    df = spark.range(30).select("id", F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), (F.col("id") % 3 + 1).cast("int")).alias("split"))
    path = str(tmp_path / "splits")
    write_split_table(df, path)
    val = read_split(spark, path, "val")
    assert val.count() == 10
    assert "PartitionFilters: [isnotnull(split" in plan_text(val)
    with pytest.raises(ValueError):
        read_split(spark, path, "dev")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_split(spark, str(tmp_path / "absent"), "val")


def png(path, pixels):
    """A minimal PNG of uint8 [height, width] or [height, width, 3]."""
    height, width = pixels.shape[:2]
    color = 2 if pixels.ndim == 3 else 0
    raw = b"".join(b"\0" + pixels[y].tobytes() for y in range(height))

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, color, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_image_scan(spark, tmp_path):
    gray = np.arange(6, dtype=np.uint8).reshape(2, 3) * 40
    color = np.array([[[255, 0, 0], [0, 255, 0], [0, 0, 255], [255, 255, 255]]], dtype=np.uint8)
    png(tmp_path / "gray.png", gray)
    png(tmp_path / "color.png", color)
    (tmp_path / "broken.png").write_bytes(b"no image")
    rows = {r["origin"].split("/")[-1]: r for r in read_images(spark, str(tmp_path)).collect()}
    assert {name: r["is_bad"] for name, r in rows.items()} == {"gray.png": False, "color.png": False, "broken.png": True}
    assert rows["broken.png"]["x"] is None and rows["broken.png"]["shape"] is None
    assert rows["gray.png"]["shape"] == [1, 2, 3]
    assert rows["gray.png"]["x"] == pytest.approx(gray.ravel() / 255, abs=1e-7)
    assert [round(v * 255) for v in rows["color.png"]["x"]] == [76, 150, 29, 255]
    assert list(gray_bytes(bytes([0, 0, 255, 9]), 4)) == [76]


def test_shapes(spark):
    df = local_table(spark, [{"x": [float(i) for i in range(784)]}, {"x": [1.0]}], "x array<float>")
    image = df.limit(1).select(vec.reshape_chw(F.col("x")).alias("i")).first()["i"]
    assert np.array(image).shape == (1, 28, 28)
    assert image[0][1][0] == 28.0
    with pytest.raises(Exception, match="expected"):
        df.select(vec.reshape_chw(F.col("x"))).collect()
    with pytest.raises(Exception, match="expected"):
        df.select(vec.require_shape(F.col("x"), (1, 28, 28))).collect()
    shapes = [r[0]["shape"] for r in df.select(vec.conditional_reshape(F.col("x"))).collect()]
    assert shapes == [[1, 28, 28], [1]]
    with pytest.raises(ValueError):
        vec.normalize(F.col("x"), (0.1, 0.2), (1.0, 1.0))


def test_scores(spark):
    df = local_table(spark, [{"s": [1.0, 3.0, 3.0, 2.0], "t": 2}, {"s": [1000.0, 0.0, 0.0, 0.0], "t": 9}], "s array<double>, t int")
    rows = df.select(
        sc.argmax_class(F.col("s")).alias("a"),
        sc.top_k_hit(F.col("s"), F.col("t"), 1).alias("k1"),
        sc.top_k_hit(F.col("s"), F.col("t"), 2).alias("k2"),
        sc.softmax(F.col("s")).alias("p"),
    ).collect()
    assert (rows[0]["a"], rows[0]["k1"], rows[0]["k2"]) == (1, False, True)
    assert (rows[1]["k1"], rows[1]["p"][0]) == (False, 1.0)


def test_feed_forward_equals_numpy(spark):
    network = FeedForward.waves(inputs=8, hidden=4, classes=3)
    x = np.arange(40, dtype=np.float64).reshape(5, 8) / 10
    df = local_table(spark, [{"i": i, "x": row.tolist()} for i, row in enumerate(x)], "i int, x array<double>")
    got = [r["p"] for r in df.select("i", score(F.col("x"), network).alias("p")).orderBy("i").collect()]
    assert np.allclose(got, network.scores(x))


def two_classes(spark, roles=("train", "train", "val", "test")):
    rows = [
        {"role": roles[i % len(roles)], "x": [float(i % 2) * 4 - 2, 1.0], "label": i % 2} for i in range(80)
    ]
    return local_table(spark, rows, "role string, x array<double>, label int")


def test_training_history(spark):
    samples = two_classes(spark)
    result = train(samples, [2, 3, 2], epochs=3, steps_per_epoch=10)
    rows = {(r["phase"], r["name"], r["epoch"]): r["value"] for r in result.metrics.collect()}
    assert {k[0] for k in rows} == {"train", "val", "test"}
    assert sorted(e for p, n, e in rows if (p, n) == ("train", "loss")) == [1, 2, 3]
    assert rows["train", "loss", 3] < rows["train", "loss", 1]
    final = {r["name"]: r["value"] for r in final_test(result.model, samples).collect()}
    assert final["loss"] == pytest.approx(rows["test", "loss", 1])
    assert final_test(result.model, samples.where("role <> 'test'")).count() == 0


def test_validation_is_optional(spark):
    result = train(two_classes(spark), [2, 3, 2], epochs=1, validate=False)
    assert {r["phase"] for r in result.metrics.collect()} == {"train", "test"}


def test_one_task_per_worker(spark):
    got = run_on_workers(spark, 3, lambda rank: [{"rank": rank, "twice": rank * 2}], "rank int, twice int").collect()
    assert sorted(map(tuple, got)) == [(0, 0), (1, 2), (2, 4)]


def test_experiment_needs_configs():
    with pytest.raises(ValueError):
        run_load_experiment([], None, 192, 3)


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_small_tables_are_checked(spark):
    table, rows = small_table(spark.range(5), 5)
    assert len(rows) == 5 and table.count() == 5
    table, rows = small_table(spark.range(6), 5)
    assert rows is None and table.count() == 6


def test_metrics_can_be_attached(spark):
    scored = spark.createDataFrame([([0.1, 0.7, 0.2], 1), ([0.5, 0.3, 0.2], 1), ([0.6, 0.3, 0.1], 2)], "scores array<double>, label int")
    metrics = {"accuracy": sc.accuracy, "top 2": lambda s, y: sc.top_k_accuracy(s, y, 2), "rows": lambda s, y: F.count(y)}
    found = {r["name"]: r["value"] for r in evaluate(scored, "val", 3, metrics=metrics).collect()}
    assert found == {"accuracy": pytest.approx(100 / 3), "top 2": pytest.approx(200 / 3), "rows": 3.0}
