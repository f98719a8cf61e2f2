"""Metrics that are no column expression: tasks update states batch by batch, a tree of two levels merges them, one state a group is finished."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Parts into which the states of a group are merged first, and groups that a task holds before it hands their states on.
FAN_IN = 64
HELD_GROUPS = 10_000


class Mergeable(Protocol):
    """A metric of scores (one row of values a sample) and labels. States are arrays of doubles of one fixed length."""

    def init(self) -> np.ndarray: ...

    def update(self, state: np.ndarray, scores: np.ndarray, labels: np.ndarray) -> np.ndarray: ...

    def merge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray: ...

    def finish(self, state: np.ndarray) -> float | None: ...


class _Counts:
    size = 0

    def init(self) -> np.ndarray:
        return np.zeros(self.size)

    def merge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left + right


class MacroF1(_Counts):
    """Mean F1 over the classes that are predicted or asked for; the first of equal scores is predicted. Labels are below `classes`."""

    def __init__(self, classes: int):
        self.classes, self.size = classes, 3 * classes

    def update(self, state, scores, labels):
        guess = scores.argmax(axis=1)
        seen = [np.bincount(found, minlength=self.classes) for found in (guess[guess == labels], guess, labels)]
        return state + np.concatenate(seen)

    def finish(self, state):
        right, guessed, asked = state.reshape(3, -1)
        known = guessed + asked > 0
        return float((2 * right[known] / (guessed + asked)[known]).mean()) if known.any() else None


class CalibrationError(_Counts):
    """Mean distance, weighted by rows, between how sure the softmax is and how often it is right, over equal bins of sureness."""

    def __init__(self, bins: int = 10):
        self.bins, self.size = bins, 3 * bins

    def update(self, state, scores, labels):
        sure = 1.0 / np.exp(scores - scores.max(axis=1, keepdims=True)).sum(axis=1)
        at = np.minimum((sure * self.bins).astype(int), self.bins - 1)
        hit = (scores.argmax(axis=1) == labels).astype(float)
        return state + np.concatenate([np.bincount(at, weights=w, minlength=self.bins) for w in (np.ones(len(at)), sure, hit)])

    def finish(self, state):
        n, sure, hit = state.reshape(3, -1)
        return float(np.abs(sure - hit).sum() / n.sum()) if n.sum() else None


def evaluate_mergeable(
    scored: DataFrame, metrics: dict[str, Mergeable], groups: list[str] | None = None, scores: str = "scores", label: str = "label", fan_in: int = FAN_IN
) -> DataFrame:
    """Rows (groups..., name, value). Without groups there is one row a metric if there are rows at all. A null group is a group of its own.

    Rows without scores or label take no part. A group may hold any share of the rows: what meets are states, one from each task, first in `fan_in` parts
    of the group and then those parts.
    """
    groups = list(groups or [])
    keys = [f"_g{i}" for i in range(len(groups))]
    rows = scored.where(F.col(scores).isNotNull() & F.col(label).isNotNull()).select(
        *[F.col(g).alias(k) for g, k in zip(groups, keys)], F.col(scores).cast("array<double>").alias("_s"), F.col(label).cast("bigint").alias("_y")
    )
    key_fields = [rows.schema[k] for k in keys]
    states = T.StructType([*key_fields, T.StructField("_task", T.IntegerType()), *[T.StructField(f"_m{i}", T.BinaryType()) for i in range(len(metrics))]])
    made, fields = list(metrics.values()), [f"_m{i}" for i in range(len(metrics))]

    def packed(held: dict, task: int, schema: pa.Schema) -> pa.RecordBatch:
        lines = [dict(zip(keys, key)) | {"_task": task} | {f: s.tobytes() for f, s in zip(fields, found)} for key, found in held.items()]
        return pa.RecordBatch.from_pylist(lines, schema=schema)

    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, task, held = to_arrow_schema(states), TaskContext.get().partitionId(), {}
        for batch in batches:
            if not batch.num_rows:
                continue
            labels = batch.column("_y").to_numpy()
            values = batch.column("_s").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            order: dict = {}
            for i, key in enumerate(zip(*[batch.column(k).to_pylist() for k in keys]) if keys else [()] * batch.num_rows):
                order.setdefault(key, []).append(i)
            for key, at in order.items():
                before = held.get(key) or [m.init() for m in made]
                held[key] = [m.update(state, values[at], labels[at]) for m, state in zip(made, before)]
            if len(held) > HELD_GROUPS:
                yield packed(held, task, schema)
                held = {}
        if held:
            yield packed(held, task, schema)

    def merged(found: pd.DataFrame) -> list[np.ndarray]:
        out = []
        for m, f in zip(made, fields):
            state = m.init()
            for part in found.sort_values("_task")[f]:
                state = m.merge(state, np.frombuffer(part))
            out.append(state)
        return out

    def merge(found: pd.DataFrame) -> pd.DataFrame:
        whole = found.iloc[[0]].copy()
        for f, state in zip(fields, merged(found)):
            whole[f] = [state.tobytes()]
        return whole

    names = list(metrics)
    results = T.StructType([*key_fields, T.StructField("name", T.StringType()), T.StructField("value", T.DoubleType())])

    def finish(found: pd.DataFrame) -> pd.DataFrame:
        whole = pd.concat([found.iloc[[0]][keys]] * len(names), ignore_index=True)
        whole["name"] = names
        whole["value"] = pd.Series([m.finish(state) for m, state in zip(made, merged(found))], dtype="float64")
        return whole

    parts = rows.mapInArrow(update, states)
    parts = parts.groupBy(*keys, F.pmod("_task", F.lit(fan_in))).applyInPandas(merge, states)
    done = parts.groupBy(*keys).applyInPandas(finish, results)
    return done.select(*[F.col(k).alias(g) for g, k in zip(groups, keys)], "name", "value")
