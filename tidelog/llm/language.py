"""Language ID: a convolutional network over bytes, applied to fixed-length windows of every whole text.

Byte embeddings pass through filters of several widths, the maximum of each filter over a window goes through a softmax. All of it is trained
in numpy. For scoring, embedding and filters are multiplied out into tables over pairs of bytes. A text's log-probabilities are the means of
those of its windows, weighted by their bytes.

Null texts and texts without letters are `und` with score 0; so is everything if no row has a language. Repeated rows get equal results.
Other columns are kept; columns named like the outputs are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.batches import slices
from tidelog.llm.learning import Adam, fold, log_softmax, training_rows

WINDOW, EMBEDDING, FILTERS, WIDTHS = 256, 8, 8, (2, 3, 4)
#: Bounds of the training sample for each language: whole texts, and their bytes.
TRAINING_ROWS, TRAINING_BYTES = 500, 1_000_000
RATE, WINDOWS_A_STEP = 0.01, 128
#: Windows seen in training, each at least 6 and at most 60 times.
SEEN = 100_000
WINDOWS_A_SLICE = 2_000


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def cut(text: str) -> list[bytes]:
    """Windows of a whole text."""
    data = text.encode()
    return [data[s : s + WINDOW] for s in range(0, len(data), WINDOW)]


def matrix(windows: list[bytes]) -> np.ndarray:
    """Windows as rows of byte values, zeros after their ends."""
    return np.frombuffer(b"".join(w.ljust(WINDOW, b"\0") for w in windows), dtype=np.uint8).reshape(-1, WINDOW)


def train(windows: np.ndarray, labels: np.ndarray, classes: int, epochs: int | None = None, seed: int = 1) -> dict:
    epochs = epochs or min(60, max(6, SEEN // len(labels)))
    random = np.random.default_rng(seed)
    model = {"embedding": random.normal(0, 0.5, (256, EMBEDDING)), "weights": random.normal(0, 0.1, (FILTERS * len(WIDTHS), classes)), "bias": np.zeros(classes)}
    model |= {f"filter{w}": random.normal(0, 0.3, (w, EMBEDDING, FILTERS)) for w in WIDTHS}
    adam = Adam(model, RATE)
    order = np.arange(len(labels))
    for _ in range(epochs):
        random.shuffle(order)
        for at in range(0, len(order), WINDOWS_A_STEP):
            some = order[at : at + WINDOWS_A_STEP]
            x, y, n = windows[some], labels[some], len(some)
            pooled, peaks = [], []
            for w in WIDTHS:
                tables = (model["embedding"] @ model[f"filter{w}"]).astype(np.float32)
                out = sum(tables[j][x[:, j : WINDOW - w + 1 + j]] for j in range(w))
                peaks.append(out.argmax(axis=1))
                pooled.append(np.take_along_axis(out, peaks[-1][:, None], 1)[:, 0])
            features = np.tanh(np.concatenate(pooled, 1).astype(np.float64))
            delta = np.exp(log_softmax(features @ model["weights"] + model["bias"]))
            delta[np.arange(n), y] -= 1
            delta /= n
            gradients = {"weights": features.T @ delta, "bias": delta.sum(axis=0), "embedding": np.zeros_like(model["embedding"])}
            back = (delta @ model["weights"].T) * (1 - features**2)
            for k, w in enumerate(WIDTHS):
                g = back[:, k * FILTERS : (k + 1) * FILTERS]
                gradients[f"filter{w}"] = np.zeros_like(model[f"filter{w}"])
                for j in range(w):
                    seen = x[np.arange(n)[:, None], peaks[k] + j]
                    gradients[f"filter{w}"][j] = np.einsum("nf,nfe->ef", g, model["embedding"][seen])
                    np.add.at(gradients["embedding"], seen, g[:, :, None] * model[f"filter{w}"][j].T[None])
            adam.descend(gradients)
    return model


class Scorer:
    """The network with its filters as tables over single bytes and over pairs of bytes."""

    def __init__(self, model: dict, names: list[str]):
        self.names = names
        self.weights, self.bias = model["weights"].astype(np.float32), model["bias"].astype(np.float32)
        self.tables = []
        for w in WIDTHS:
            single = (model["embedding"] @ model[f"filter{w}"]).astype(np.float32)
            pairs = [(single[j][:, None] + single[j + 1][None]).reshape(65_536, FILTERS) for j in range(0, w - 1, 2)]
            self.tables.append((w, pairs, single[w - 1] if w % 2 else None))

    def windows(self, x: np.ndarray) -> np.ndarray:
        """Log-probabilities of each window."""
        pair = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        pooled = []
        for w, pairs, single in self.tables:
            n = WINDOW - w + 1
            out = pairs[0].take(pair[:, :n], axis=0)
            for k, table in enumerate(pairs[1:], 1):
                out += table.take(pair[:, 2 * k : 2 * k + n], axis=0)
            if single is not None:
                out += single.take(x[:, w - 1 : w - 1 + n], axis=0)
            pooled.append(out.max(axis=1))
        return log_softmax(np.tanh(np.concatenate(pooled, 1)) @ self.weights + self.bias)

    def texts(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        known = [t is not None and has_letter(t) for t in texts]
        cuts = [cut(t) if k else [] for t, k in zip(texts, known, strict=True)]
        sums = np.zeros((len(texts), len(self.names)))
        of = np.repeat(np.arange(len(texts)), [len(c) for c in cuts])
        flat = [w for c in cuts for w in c]
        for at in range(0, len(flat), WINDOWS_A_SLICE):
            some = flat[at : at + WINDOWS_A_SLICE]
            found = self.windows(matrix(some)) * np.array([len(w) for w in some])[:, None]
            np.add.at(sums, of[at : at + len(some)], found)
        total = np.bincount(of, [len(w) for w in flat], len(texts))
        chance = np.exp(log_softmax(sums / np.maximum(total, 1)[:, None]))
        best = chance.argmax(axis=1)
        return (
            [self.names[b] if k else "und" for b, k in zip(best, known, strict=True)],
            [float(chance[i, b]) if k else 0.0 for i, (b, k) in enumerate(zip(best, known, strict=True))],
        )


def fit(df: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> tuple[dict, list[str]] | None:
    """Train on at most `rows` rows for each label of `labels` (doc_id, label), with the whole texts of `df` (doc_id, text)."""
    found = training_rows(df, labels, rows, TRAINING_BYTES).collect()  # bounded by rows and bytes for each language
    pairs = sorted((r.label, w) for r in found if r.text and has_letter(r.text) for w in cut(r.text))
    if not pairs:
        return None
    names = sorted({a for a, _ in pairs})
    index = {a: i for i, a in enumerate(names)}
    return train(matrix([w for _, w in pairs]), np.array([index[a] for a, _ in pairs]), len(names)), names


def identify(documents: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """Add held_out, lang_pred and score to `documents` (doc_id, text, lang, ...), learned outside the held-out fold."""
    known = documents.where(F.col("lang").isNotNull() & (fold("doc_id", folds) != held)).select("doc_id", F.col("lang").alias("label"))
    fitted = fit(documents.select("doc_id", "text"), known)
    shared = documents.sparkSession.sparkContext.broadcast(fitted)
    kept = [c for c in documents.columns if c not in ("lang_pred", "score")]
    schema = documents.select(*[F.col(f"`{c}`") for c in kept]).schema.add("lang_pred", "string").add("score", "double")
    at = kept.index("text")

    def run(batches):
        scorer = None
        for batch in batches:
            for part in slices(batch, at):
                texts = part.column(at).to_pylist()
                if shared.value is None:
                    names, scores = ["und"] * len(texts), [0.0] * len(texts)
                else:
                    scorer = scorer or Scorer(*shared.value)
                    names, scores = scorer.texts(texts)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    scored = documents.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)
    return scored.withColumn("held_out", fold("doc_id", folds) == held)
