"""Toxicity: subword-bag embeddings, averaged, into a linear softmax; both are trained together.

A word is the mean of the vectors of its character n-grams (and of itself), so a misspelling shares most of its vector with the known word.
A window is the mean of `WINDOW` words; a document is judged by its worst window, by the mean of its `WORST` worst ones, so that long texts do not
thin out what they hold, and by its length, since the worst of many windows is worse by chance. With windows of one word no neighbour thins it out
either: of the sizes from 1 to 16 that was the most accurate. For training, a document's label belongs to all its windows at first; in the second
half, a toxic one's belongs to its worst windows only. Every fifth text is kept out of that and calibrates the three values; with fewer than ten
texts of a label all texts do both.

Every whole text gets a score: null and empty texts, and texts without words, that of an empty window. With no labelled rows every score is
0.5; with labels of one kind only, the smoothed share of label 1. Repeated rows get equal scores. Null labels and ids teach nothing. Other
columns are kept; columns named like the outputs are replaced.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.batches import with_column
from tidelog.llm.learning import Adam, calibrate, fold, log_softmax, sigmoid, training_rows

BUCKETS, WIDTH, GRAMS, WINDOW = 1 << 17, 8, (4, 5, 6), 1
#: Bound of the training sample: documents of each label, with their whole texts (`learning.TRAINING_BYTES` bounds those).
TRAINING_ROWS = 1_500
RATE, TABLE_RATE, DECAY, DOCS_A_STEP = 0.01, 0.1, 0.0005, 64
#: Documents seen in training, each at least 6 and at most 40 times. A document is judged by so many of its worst windows.
SEEN, WORST = 16_000, 3
CACHED_WORDS = 200_000
_letters = re.compile(r"\W+").sub


def grams(word: str) -> list[int]:
    """Buckets of a word's character n-grams and of the word itself; punctuation does not count."""
    bare = f"<{_letters('', word)}>"
    found = [zlib.crc32(bare[i : i + n].encode()) % BUCKETS for n in GRAMS for i in range(len(bare) - n + 1)]
    found.append(zlib.crc32(bare.encode()) % BUCKETS)
    return found


def words(text: str | None) -> list[str]:
    return (text or "").lower().split()


class Sample:
    """Training texts as windows of word numbers, and words as n-gram numbers."""

    def __init__(self, texts: list[str], labels: np.ndarray):
        index: dict[str, int] = {}
        self.labels = labels
        flat, sizes, of = [], [], []
        for i, text in enumerate(texts):
            found = [index.setdefault(w, len(index)) for w in words(text)]
            flat.append(np.array(found, dtype=np.int32))
            each = [min(WINDOW, len(found) - s) for s in range(0, len(found), WINDOW)]
            sizes += each
            of += [i] * len(each)
        self.flat = np.concatenate(flat) if flat else np.zeros(0, np.int32)
        self.sizes, self.of = np.array(sizes, dtype=np.int64), np.array(of, dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        each = [np.array(grams(w), dtype=np.int32) for w in index]
        self.gram_sizes = np.array([len(g) for g in each], dtype=np.int64)
        self.gram_starts = np.cumsum(self.gram_sizes) - self.gram_sizes
        self.grams = np.concatenate(each) if each else np.zeros(0, np.int32)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of several slices one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def forward(model: dict, sample: Sample, chosen: np.ndarray) -> tuple:
    sizes = sample.sizes[chosen]
    used, at = np.unique(sample.flat[ranges(sample.starts[chosen], sizes)], return_inverse=True)
    gram_sizes = sample.gram_sizes[used]
    rows = sample.grams[ranges(sample.gram_starts[used], gram_sizes)]
    vectors = np.add.reduceat(model["table"][rows], np.cumsum(gram_sizes) - gram_sizes) / gram_sizes[:, None]
    means = np.add.reduceat(vectors[at], np.cumsum(sizes) - sizes) / sizes[:, None]
    return means, means @ model["weights"] + model["bias"], (sizes, used, at, gram_sizes, rows)


def train(texts: list[str], labels: np.ndarray, epochs: int | None = None, seed: int = 1) -> dict:
    """Fit the table and the softmax; return the log-odds that each bucket adds, the offset, and the calibration of a document's values.

    `labels` holds a 0 or 1 for each text.
    """
    if not len(labels):
        return {"bucket": np.zeros(BUCKETS, np.float32), "bias": 0.0, "slopes": [0.0] * 3, "offset": 0.0}
    calibrates = np.zeros(len(labels), dtype=bool)
    for label in (0, 1):
        calibrates[np.flatnonzero(labels == label)[4::5]] = True
    if np.bincount(labels, minlength=2).min() < 10:
        model = network(texts, labels, epochs, seed)
        calibrates[:] = True
    else:
        taught = np.flatnonzero(~calibrates)
        model = network([texts[i] for i in taught], labels[taught], epochs, seed)
    scorer = Scorer(model)
    values = np.array([scorer.values(texts[i]) for i in np.flatnonzero(calibrates)])
    slopes, offset = calibrate(values, labels[calibrates])
    return model | {"slopes": slopes, "offset": offset}


def network(texts: list[str], labels: np.ndarray, epochs: int | None, seed: int) -> dict:
    """The log-odds that each bucket adds, and the offset."""
    epochs = epochs or min(40, max(6, SEEN // len(labels)))
    random = np.random.default_rng(seed)
    model = {
        "table": random.normal(0, 0.05, (BUCKETS, WIDTH)).astype(np.float32),
        "weights": random.normal(0, 0.5, (WIDTH, 2)).astype(np.float32),
        "bias": np.zeros(2, np.float32),
    }
    sample = Sample(texts, labels)
    dense = Adam({k: model[k] for k in ("weights", "bias")}, RATE)
    where = np.split(np.argsort(sample.of, kind="stable"), np.cumsum(np.bincount(sample.of, minlength=len(labels)))[:-1])
    docs = np.array([d for d, x in enumerate(where) if len(x)], dtype=np.int64)
    balance = len(labels) / max(1, labels.sum())
    for epoch in range(epochs):
        random.shuffle(docs)
        for at in range(0, len(docs), DOCS_A_STEP):
            chosen = np.concatenate([where[d] for d in docs[at : at + DOCS_A_STEP]])
            means, logits, (sizes, used, inverse, gram_sizes, rows) = forward(model, sample, chosen)
            odds, doc = logits[:, 1] - logits[:, 0], sample.of[chosen]
            order = np.lexsort((-odds, doc))
            begins = np.flatnonzero(np.diff(doc[order], prepend=-1))
            rank = np.empty(len(doc), dtype=np.int64)
            rank[order] = np.arange(len(doc)) - np.repeat(begins, np.diff(np.append(begins, len(doc))))
            chief = rank < WORST
            y = labels[doc]
            weight = np.where(y == 1, balance, 1.0)
            if epoch >= epochs // 2:
                weight[(y == 1) & ~chief] = 0
            delta = np.exp(log_softmax(logits))
            delta[np.arange(len(y)), y] -= 1
            delta *= weight[:, None]
            dense.descend({"weights": means.T @ delta / len(y), "bias": delta.mean(axis=0)})
            spread = np.repeat(delta @ model["weights"].T, sizes, axis=0)
            by_word = np.stack([np.bincount(inverse, spread[:, k], len(used)) for k in range(WIDTH)], 1)
            by_gram = np.repeat(by_word / gram_sizes[:, None], gram_sizes, axis=0)
            touched, place = np.unique(rows, return_inverse=True)
            gradient = np.stack([np.bincount(place, by_gram[:, k], len(touched)) for k in range(WIDTH)], 1)
            model["table"][touched] -= TABLE_RATE * np.clip(gradient, -5, 5) + DECAY * model["table"][touched]
    direction = model["weights"][:, 1] - model["weights"][:, 0]
    return {"bucket": (model["table"] @ direction).astype(np.float32), "bias": float(model["bias"][1] - model["bias"][0])}


class Scorer:
    """Scores whole texts. Words are looked up; a window's log-odds is the mean of its words'."""

    def __init__(self, model: dict):
        self.model, self.bucket = model, model["bucket"].tolist()
        self.known: dict[str, float] = {}

    def word(self, word: str) -> float:
        found = [self.bucket[g] for g in grams(word)]
        return sum(found) / len(found)

    def values(self, text: str | None) -> tuple[float, float, float]:
        """Log-odds of the worst window, their mean over the `WORST` worst ones, and the logarithm of the number of words."""
        found, known = words(text), self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        values = []
        for w in found:
            value = known.get(w)
            if value is None:
                value = self.word(w)
                if len(w) < 100:
                    known[w] = value
            values.append(value)
        if WINDOW > 1:
            values = [sum(x) / len(x) for x in (values[s : s + WINDOW] for s in range(0, len(values), WINDOW))]
        worst, bias = heapq.nlargest(WORST, values) or [0.0], self.model["bias"]
        return bias + worst[0], bias + sum(worst) / len(worst), math.log1p(len(found))

    def score(self, text: str | None) -> float:
        return float(sigmoid(sum(a * b for a, b in zip(self.model["slopes"], self.values(text), strict=True)) + self.model["offset"]))


def fit(df: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> dict:
    """Train on at most `rows` rows for each label of `labels` (doc_id, label), with the whole texts of `df` (doc_id, text)."""
    chosen = training_rows(df, labels.where(F.col("label").isin(0, 1)), rows)
    found = sorted((int(r.label), r.text or "") for r in chosen.collect())  # bounded by rows and bytes
    return train([t for _, t in found], np.array([y for y, _ in found], dtype=np.int64))


def score(df: DataFrame, model: dict, text: str = "text", name: str = "score") -> DataFrame:
    """Add the toxicity of every whole text, from 0 to 1."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def setup():
        scorer = Scorer(shared.value)
        return lambda texts: pa.array([scorer.score(t) for t in texts.to_pylist()], pa.float64())

    return with_column(df, text, name, T.DoubleType(), setup)


def classify(documents: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, threshold: float = 0.5) -> DataFrame:
    """Score `documents` (doc_id, text, ...) with a model of `labels` (doc_id, toxic) outside the held-out fold; adds held_out, score, predicted."""
    known = labels.where(fold("doc_id", folds) != held).select("doc_id", F.col("toxic").alias("label"))
    model = fit(documents.select("doc_id", "text"), known)
    scored = score(documents, model)
    return scored.withColumns({"held_out": fold("doc_id", folds) == held, "predicted": (F.col("score") >= threshold).cast("int")})
