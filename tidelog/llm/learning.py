"""What the classifiers share: bounded training samples and small numpy helpers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of the whole texts that teach one label; the sample holds at most twice as many.
TRAINING_BYTES = 8_000_000


def fold(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; a null id counts as empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % parts


def training_rows(df: DataFrame, labels: DataFrame, rows: int, most: int = TRAINING_BYTES, cost: Column | None = None) -> DataFrame:
    """A bounded sample of whole texts of `df` (doc_id, text) for each label of `labels` (doc_id, label): label and text.

    Each label gets at most `rows` texts, those whose ids have the least hashes, and of these as many as come before a cost of `most` bytes is
    reached (`cost`, by default the bytes of the text); a text that costs more alone teaches nothing. Texts are never cut. Rows stored again count
    once. Ids are chosen by a narrow pass, each task passing on at most `rows` of a label.
    """
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    known = labels.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull()).select("doc_id", "label").distinct()
    chosen = known.withColumn("_n", F.row_number().over(Window.partitionBy("label").orderBy(*by_hash))).where(F.col("_n") <= rows).drop("_n")
    # At most `rows` narrow rows for each label are broadcast; equal rows meet before they are shuffled.
    met = df.join(F.broadcast(chosen), "doc_id").groupBy("label", "doc_id", F.xxhash64("text").alias("_hash")).agg(F.first("text").alias("text"))
    order = Window.partitionBy("label").orderBy(*by_hash, "_hash")
    first = met.withColumn("_cost", F.coalesce(F.octet_length("text") if cost is None else cost, F.lit(0)).cast("long")).where(F.col("_cost") <= most)
    first = first.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= rows)
    before = F.coalesce(F.sum("_cost").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return first.withColumn("_before", before).where(F.col("_before") <= most).select("label", "text")


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


class Adam:
    """Moment estimates for a dictionary of arrays that is updated in place."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float):
        self.weights, self.rate, self.step = weights, rate, 0
        self.first = {k: np.zeros_like(v) for k, v in weights.items()}
        self.second = {k: np.zeros_like(v) for k, v in weights.items()}

    def descend(self, gradients: dict[str, np.ndarray]) -> None:
        self.step += 1
        for k, g in gradients.items():
            self.first[k] += 0.1 * (g - self.first[k])
            self.second[k] += 0.001 * (g * g - self.second[k])
            mean, square = self.first[k] / (1 - 0.9**self.step), self.second[k] / (1 - 0.999**self.step)
            self.weights[k] -= self.rate * mean / (np.sqrt(square) + 1e-8)


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[list[float], float]:
    """Slopes and offset that turn rows of values into log-odds (logistic regression with a small ridge)."""
    n, k = x.shape
    if len(set(y.tolist())) < 2:
        return [0.0] * k, float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    scale = np.abs(x).max(axis=0)
    scale[scale == 0] = 1
    design, beta = np.column_stack([x / scale, np.ones(n)]), np.zeros(k + 1)
    for _ in range(100):
        p = sigmoid(design @ beta)
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(k + 1)
        step = np.linalg.solve(hessian, design.T @ (y - p) - 1e-2 * beta)
        beta += step * min(1.0, 5 / max(float(np.abs(step).max()), 1e-12))
    return (beta[:-1] / scale).tolist(), float(beta[-1])
