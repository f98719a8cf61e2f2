"""Training, evaluation and batch scoring over tables, on MLlib and batch inference."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from tidelog.functions.scores import accuracy, argmax_class, cross_entropy
from tidelog.functions.vectors import reshape_chw
from tidelog.operators.assemble import LOADERS
from tidelog.session import local_table


@dataclass(frozen=True)
class FeedForward:
    """Weights of a two-layer network: linear, ReLU, linear, softmax."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    @classmethod
    def waves(cls, inputs: int = 784, hidden: int = 128, classes: int = 10, scale: float = 1.0) -> "FeedForward":
        """Repeatable weights from a sine rule, for checks without a trained model."""

        def matrix(rows: int, columns: int, phase: float) -> np.ndarray:
            i, j = np.meshgrid(np.arange(rows), np.arange(columns), indexing="ij")
            return scale * np.sin(i * 0.7 + j * 1.3 + phase)

        return cls(matrix(inputs, hidden, 0.0), np.zeros(hidden), matrix(hidden, classes, 0.5), np.zeros(classes))

    def outputs(self, x: np.ndarray) -> np.ndarray:
        """Outputs before the softmax."""
        hidden = np.maximum(x.astype(np.float64) @ self.w1 + self.b1, 0.0)
        return hidden @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = self.outputs(x)
        out = np.exp(out - out.max(axis=1, keepdims=True))
        return out / out.sum(axis=1, keepdims=True)


def score(x: Column, network: FeedForward, batch_size: int = 1024, raw: bool = False) -> Column:
    """Class probabilities per row, or with `raw` the outputs before the softmax, computed per Arrow batch as one matrix product."""
    width = network.w1.shape[0]

    def make_predict():
        return network.outputs if raw else network.scores

    udf = predict_batch_udf(
        make_predict,
        return_type=T.ArrayType(T.DoubleType()),
        batch_size=batch_size,
        input_tensor_shapes=[[width]],
    )
    return udf(x)


def prediction_grid(scored: DataFrame, key: str, shape: tuple[int, int, int], rows: int = 5, columns: int = 8) -> DataFrame:
    """The first rows x columns predictions in key order, with predicted class and reshaped image."""
    return (
        scored.orderBy(key)
        .limit(rows * columns)
        .select(key, argmax_class(F.col("scores")).alias("pred"), reshape_chw(F.col("x"), shape).alias("image"))
    )


#: A metric turns columns of scores and labels into an aggregate.
Metrics = dict[str, Callable[[Column, Column], Column]]
METRICS: Metrics = {"accuracy": accuracy, "loss": cross_entropy}


def evaluate(
    scored: DataFrame, phase: str, epoch: int, scores: str = "scores", label: str = "label", metrics: Metrics = METRICS
) -> DataFrame:
    """Metric rows (phase, epoch, name, value) of a scored table, all from one aggregate."""
    values = scored.agg(*[make(F.col(scores), F.col(label)).cast("double").alias(f"_m{i}") for i, make in enumerate(metrics.values())])
    rows = F.array(*[F.struct(F.lit(name).alias("name"), F.col(f"_m{i}").alias("value")) for i, name in enumerate(metrics)])
    return values.select(F.lit(phase).alias("phase"), F.lit(epoch).alias("epoch"), F.inline(rows))


@dataclass(frozen=True)
class TrainedModel:
    model: object
    metrics: DataFrame


def _scored(model, df: DataFrame) -> DataFrame:
    """Raw outputs as scores; the loss is the cross entropy of their softmax, as MLlib's output layer applies it."""
    return model.transform(df).select(
        vector_to_array("rawPrediction").alias("scores"), F.col("label").cast("int").alias("label")
    )


def train(
    samples: DataFrame,
    layers: list[int],
    epochs: int,
    steps_per_epoch: int = 5,
    validate: bool = True,
    seed: int = 42,
    metrics: Metrics = METRICS,
) -> TrainedModel:
    """Fit on the `train` rows of (role, x, label) and keep metrics per epoch; test once at the end.

    An epoch is a fit of a fixed number of steps that resumes from the last weights; each restarts the optimizer's
    own history. Hidden units are sigmoid. Features are stored once, spilling to disk, and every fit reads them from there.
    """
    vectors = samples.select(
        "role", array_to_vector(F.col("x").cast("array<double>")).alias("features"), F.col("label").cast("double").alias("label")
    ).persist(StorageLevel.MEMORY_AND_DISK)
    spark = samples.sparkSession
    found = vectors.where(F.col("role").isin(*LOADERS)).select("role").distinct()
    roles = {r["role"] for r in found.collect()}
    learner = MultilayerPerceptronClassifier(
        layers=layers, maxIter=steps_per_epoch, seed=seed, featuresCol="features", labelCol="label"
    )
    rows: list[dict] = []
    model = None
    try:
        for epoch in range(1, epochs + 1):
            if model is not None:
                learner = learner.setInitialWeights(model.weights)
            model = learner.fit(vectors.where(F.col("role") == "train"))
            phases = ["train"] + (["val"] if validate and "val" in roles else [])
            if epoch == epochs and "test" in roles:
                phases.append("test")
            for phase in phases:
                scored = _scored(model, vectors.where(F.col("role") == phase))
                rows += [r.asDict() for r in evaluate(scored, phase, epoch if phase != "test" else 1, metrics=metrics).collect()]
    finally:
        vectors.unpersist()
    return TrainedModel(model, local_table(spark, rows, "phase string, epoch int, name string, value double"))


def final_test(model, samples: DataFrame, metrics: Metrics = METRICS) -> DataFrame:
    """Metrics of the `test` rows, no rows where there are none."""
    vectors = samples.where(F.col("role") == "test").select(
        array_to_vector(F.col("x").cast("array<double>")).alias("features"), F.col("label").cast("double").alias("label")
    )
    return evaluate(_scored(model, vectors), "test", 1, metrics=metrics).where(F.col("value").isNotNull())


def run_on_workers(
    spark: SparkSession, workers: int, task: Callable[[int], Iterator[dict]], schema: str, barrier: bool = False
) -> DataFrame:
    """Run `task(rank)` once per worker, each in its own task; with `barrier` all of them start together."""
    arrow = _arrow_schema(schema)

    def call(batches):
        for batch in batches:
            for rank in batch.column("rank").to_pylist():
                rows = list(task(rank))
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    ranks = spark.range(workers).select(F.col("id").cast("int").alias("rank"))
    return ranks.repartitionById(workers, F.col("rank")).mapInArrow(call, schema, barrier=barrier)


def map_workers(
    placed: DataFrame, task: Callable[[pa.RecordBatch], Iterator[dict]], schema: str
) -> DataFrame:
    """Run `task` over every Arrow batch of a rank-placed table, in the worker that holds it."""
    arrow = _arrow_schema(schema)

    def call(batches):
        for batch in batches:
            rows = list(task(batch))
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return placed.mapInArrow(call, schema)


def _arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(schema))
