"""Data-parallel training of the ReLU network: tasks sum gradients, a tree of tasks adds the sums, the optimizer keeps its state for the whole run.

What travels is the size of the model, never that of the data: one broadcast of the weights and at most `FAN_IN` gradients to the driver for each step.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.lets import idiv
from tidelog.operators.assemble import LOADERS
from tidelog.operators.train import METRICS, FeedForward, Metrics, evaluate, score
from tidelog.session import local_table, scratch_path

#: Gradients that one task, or the driver, adds up.
FAN_IN = 64

SUMS = "task int, n bigint, loss double, hits bigint, gradient binary"


@dataclass(frozen=True)
class Sgd:
    """Gradient descent with momentum: the velocity starts as the first gradient."""

    rate: float = 0.01
    momentum: float = 0.0

    def step(self, weights: np.ndarray, gradient: np.ndarray, state: dict) -> tuple[np.ndarray, dict]:
        velocity = gradient + self.momentum * state["velocity"] if state else gradient
        return weights - self.rate * velocity, {"velocity": velocity}


@dataclass(frozen=True)
class Adam:
    rate: float = 0.001
    beta1: float = 0.9
    beta2: float = 0.999
    eps: float = 1e-8

    def step(self, weights: np.ndarray, gradient: np.ndarray, state: dict) -> tuple[np.ndarray, dict]:
        t = state.get("t", 0) + 1
        mean = self.beta1 * state.get("mean", 0.0) + (1 - self.beta1) * gradient
        square = self.beta2 * state.get("square", 0.0) + (1 - self.beta2) * gradient**2
        change = mean / (1 - self.beta1**t) / (np.sqrt(square / (1 - self.beta2**t)) + self.eps)
        return weights - self.rate * change, {"t": t, "mean": mean, "square": square}


def flat(network: FeedForward) -> np.ndarray:
    return np.concatenate([network.w1.ravel(), network.b1, network.w2.ravel(), network.b2]).astype(np.float64)


def shaped(weights: np.ndarray, like: FeedForward) -> FeedForward:
    parts, at = [], 0
    for part in (like.w1, like.b1, like.w2, like.b2):
        parts.append(weights[at : at + part.size].reshape(part.shape))
        at += part.size
    return FeedForward(*parts)


def gradient_sums(network: FeedForward, x: np.ndarray, label: np.ndarray) -> tuple[float, int, np.ndarray]:
    """Summed cross entropy, right answers and summed gradient of some rows."""
    raw = x @ network.w1 + network.b1
    hidden = np.maximum(raw, 0.0)
    out = hidden @ network.w2 + network.b2
    top = out.max(axis=1, keepdims=True)
    log_p = out - top - np.log(np.exp(out - top).sum(axis=1, keepdims=True))
    rows = np.arange(len(label))
    error = np.exp(log_p)
    error[rows, label] -= 1.0
    back = (error @ network.w2.T) * (raw > 0)
    gradient = FeedForward(x.T @ back, back.sum(axis=0), hidden.T @ error, error.sum(axis=0))
    return float(-log_p[rows, label].sum()), int((out.argmax(axis=1) == label).sum()), flat(gradient)


def _partial_sums(rows: DataFrame, network: FeedForward) -> tuple[DataFrame, Broadcast]:
    """One row of sums for each task that has rows, and the broadcast weights they need."""
    width = network.w1.shape[0]
    shared = rows.sparkSession.sparkContext.broadcast(network)

    def call(batches):
        n, loss, hits, total = 0, 0.0, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            more_loss, more_hits, gradient = gradient_sums(shared.value, x, batch.column("label").to_numpy())
            n, loss, hits = n + batch.num_rows, loss + more_loss, hits + more_hits
            total = gradient if total is None else total + gradient
        if n:
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict(
                {
                    "task": pa.array([task], pa.int32()),
                    "n": pa.array([n], pa.int64()),
                    "loss": pa.array([loss], pa.float64()),
                    "hits": pa.array([hits], pa.int64()),
                    "gradient": pa.array([total.tobytes()], pa.binary()),
                }
            )

    return rows.select("x", "label").mapInArrow(call, SUMS), shared


def _added(sums: pd.DataFrame) -> pd.DataFrame:
    """Sums of some tasks as one row, added in the order of tasks."""
    sums = sums.sort_values("task")
    total = np.zeros(len(sums["gradient"].iloc[0]) // 8)
    for part in sums["gradient"]:
        total += np.frombuffer(part)
    return pd.DataFrame(
        {"task": [sums["task"].iloc[0]], "n": [sums["n"].sum()], "loss": [sums["loss"].sum()], "hits": [sums["hits"].sum()], "gradient": [total.tobytes()]}
    )


def total_sums(rows: DataFrame, network: FeedForward, fan_in: int = FAN_IN) -> tuple[int, float, int, np.ndarray] | None:
    """Rows, summed loss, right answers and summed gradient of a table of (x, label); None for an empty one."""
    tasks = rows.rdd.getNumPartitions()
    sums, shared = _partial_sums(rows, network)
    wide = 1
    while tasks > fan_in:
        wide, tasks = wide * fan_in, -(-tasks // fan_in)
        sums = sums.groupBy(idiv("task", wide)).applyInPandas(_added, SUMS)
    try:
        found = sums.toPandas()
    finally:
        shared.destroy()
    if found.empty:
        return None
    whole = _added(found).iloc[0]
    return int(whole["n"]), float(whole["loss"]), int(whole["hits"]), np.frombuffer(whole["gradient"])


@dataclass(frozen=True)
class TrainedNetwork:
    network: FeedForward
    metrics: DataFrame
    state: dict = field(repr=False)


def _dealt(samples: DataFrame, network: FeedForward) -> DataFrame:
    """Samples stored by role and step, so that a step reads its own rows only. A step is dealt over many tasks."""
    width, classes = network.w1.shape[0], network.b2.size
    whole = (F.size("x") == width) & F.forall("x", lambda v: v.isNotNull()) & F.col("label").between(0, classes - 1)
    step = F.col("step").cast("int") if "step" in samples.columns else F.lit(0)
    good = F.coalesce(whole & step.isNotNull(), F.lit(False))
    broken = F.raise_error(F.lit(f"a sample needs {width} values, a label below {classes} and a step"))
    path = scratch_path(samples.sparkSession, "steps")
    dealt = samples.where(F.col("role").isin(*LOADERS)).select(
        "role",
        F.when(good, step).otherwise(broken.cast("int")).alias("step"),
        F.col("x").cast("array<double>").alias("x"),
        F.col("label").cast("bigint").alias("label"),
    )
    dealt.repartitionByRange("role", "step", F.rand(7)).write.partitionBy("role", "step").parquet(path)
    schema = "x array<double>, label bigint, role string, step int"
    return samples.sparkSession.read.schema(schema).parquet(path)


def train_network(
    samples: DataFrame,
    network: FeedForward,
    optimizer: Sgd | Adam = Sgd(),
    epochs: int = 1,
    validate: bool = True,
    metrics: Metrics = METRICS,
    state: dict | None = None,
    fan_in: int = FAN_IN,
) -> TrainedNetwork:
    """Train on the `train` rows of (role, x, label) and, if there is one, `step`: the batch a row belongs to, in order from the smallest.

    Each step is one gradient over all rows of its batch in all tasks, and one update by their mean; without `step` an epoch is one batch.
    Metrics: `train` accuracy and loss are gathered during the epoch, before each update; `val` after each epoch; `test` once, at the end.
    Roles without rows give no metrics, and no `train` rows leave the network as it is. `state` goes on from a run before.
    A sample with null or missing values, an unknown label or a null step is an error. Rows of other roles take no part.
    """
    spark = samples.sparkSession
    dealt = _dealt(samples, network)
    held = [tuple(r) for r in dealt.groupBy("role", "step").agg(F.count("label")).select("role", "step").collect()]
    steps, roles = sorted(s for role, s in held if role == "train"), {role for role, _ in held}
    weights, state = flat(network), dict(state or {})
    rows: list[dict] = []
    for epoch in range(1, epochs + 1):
        n = hits = 0
        loss = 0.0
        for step in steps:
            batch = dealt.where((F.col("role") == "train") & (F.col("step") == step))
            more, more_loss, more_hits, gradient = total_sums(batch, shaped(weights, network), fan_in)
            n, loss, hits = n + more, loss + more_loss, hits + more_hits
            weights, state = optimizer.step(weights, gradient / more, state)
        if n:
            rows += [{"phase": "train", "epoch": epoch, "name": k, "value": v} for k, v in (("accuracy", 100.0 * hits / n), ("loss", loss / n))]
        phases = (["val"] if validate else []) + (["test"] if epoch == epochs else [])
        for phase in phases:
            if phase in roles:
                found = evaluate_network(shaped(weights, network), dealt, phase, 1 if phase == "test" else epoch, metrics)
                rows += [r.asDict() for r in found.collect()]
    return TrainedNetwork(shaped(weights, network), local_table(spark, rows, "phase string, epoch int, name string, value double"), state)


def evaluate_network(network: FeedForward, samples: DataFrame, phase: str = "test", epoch: int = 1, metrics: Metrics = METRICS) -> DataFrame:
    """Metrics of the rows of one role, from the outputs before the softmax; no rows where there are none."""
    asked = samples.where(F.col("role") == phase)
    scored = asked.select(score(F.col("x").cast("array<double>"), network, raw=True).alias("scores"), F.col("label").cast("int").alias("label"))
    return evaluate(scored, phase, epoch, metrics=metrics).where(F.col("value").isNotNull())
