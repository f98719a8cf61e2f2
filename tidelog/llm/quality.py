"""Quality: a linear-chain conditional random field labels every line good or bad; the document's score is their length-weighted mean.

A line's features are shares of kinds of characters, its length and how its words repeat, together with those of the lines before and after
it. Forward and backward passes give each line's chance of being good. For training, all lines of a document bear its label.

Null and empty texts are one empty line and get its score. With no labelled rows every score is 0.5. Repeated rows get equal scores. Null
labels and ids teach nothing. Other columns are kept; columns named like the outputs are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.batches import slices, with_column
from tidelog.llm.learning import Adam, fold, training_rows

#: Bounds of the training sample: documents of each label with their whole texts, and their bytes, with so many more for each line.
TRAINING_ROWS, TRAINING_BYTES, LINE_BYTES = 2_500, 64_000_000, 300
STEPS, RATE = 120, 0.05

# Kinds of bytes: lower case, capital, digit, space, stop or comma, exclamation or question mark, bar, other sign, beyond ASCII.
KINDS = 9
_kind = np.full(256, 7, dtype=np.uint8)
_kind[ord("a") : ord("z") + 1] = 0
_kind[ord("A") : ord("Z") + 1] = 1
_kind[ord("0") : ord("9") + 1] = 2
_kind[[32, 9, 10, 13]] = 3
_kind[[ord("."), ord(",")]] = 4
_kind[[ord("!"), ord("?")]] = 5
_kind[ord("|")] = 6
_kind[128:] = 8
_powers = np.array([pow(1_000_003, k, 1 << 64) for k in range(64)], dtype=np.uint64)
OWN = KINDS + 4


def line_features(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Own features of lines that lie one after another in `data`, each followed by one byte of white space."""
    kinds = _kind[data]
    ends = starts + sizes
    shares = np.empty((len(starts), OWN))
    for k in range(KINDS):
        total = np.concatenate([[0], np.cumsum(kinds == k, dtype=np.int64)])
        shares[:, k] = total[ends] - total[starts]
    # Words: where a byte that is no space follows one that is.
    inside = kinds != 3
    first = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    word_count = np.zeros(len(starts))
    repeats, again = np.zeros(len(starts)), np.zeros(len(starts))
    if len(first):
        position = np.arange(len(data)) - np.repeat(first, np.diff([*first, len(data)]))[: len(data)] if first[0] == 0 else np.arange(len(data)) - np.concatenate([np.zeros(first[0], np.int64), np.repeat(first, np.diff([*first, len(data)]))])
        value = np.where(inside, (data.astype(np.uint64) + 1) * _powers[np.minimum(position, 63)], 0)
        word = np.add.reduceat(value, first)
        line = np.searchsorted(starts, first, side="right") - 1
        word_count = np.bincount(line, minlength=len(starts)).astype(float)
        same = np.concatenate([[False], (word[1:] == word[:-1]) & (line[1:] == line[:-1])])
        repeats = np.bincount(line[same], minlength=len(starts)).astype(float)
        order = np.lexsort((word, line))
        twin = (word[order][1:] == word[order][:-1]) & (line[order][1:] == line[order][:-1])
        again = np.bincount(line[order][1:][twin], minlength=len(starts)).astype(float)
    shares[:, :KINDS] /= np.maximum(sizes, 1)[:, None]
    shares[:, KINDS] = np.log1p(sizes) / 5
    shares[:, KINDS + 1] = np.minimum(sizes / np.maximum(word_count, 1) / 10, 3)
    shares[:, KINDS + 2] = repeats / np.maximum(word_count, 1)
    shares[:, KINDS + 3] = again / np.maximum(word_count, 1)
    return shares


def documents_lines(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of some texts, with neighbours; lines per text; line lengths in bytes."""
    data = np.frombuffer("\n".join(t or "" for t in texts).encode() + b"\n", dtype=np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    counts = np.array([(t or "").count("\n") + 1 for t in texts])
    own = line_features(data, starts, ends - starts)
    last = np.cumsum(counts) - 1
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    is_first, is_last = np.zeros((len(own), 1)), np.zeros((len(own), 1))
    is_first[last - counts + 1], is_last[last] = 1, 1
    before[is_first[:, 0] == 1], after[is_last[:, 0] == 1] = 0, 0
    return np.concatenate([own, before, after, is_first, is_last, np.ones((len(own), 1))], 1), counts, ends - starts


FEATURES = 3 * OWN + 3


def chains(counts: np.ndarray, most: int = 400, cells: int = 1 << 18):
    """Groups of documents of like length: their numbers and, padded to the longest, the line numbers and a mask. A group has at most `cells` lines,
    padding included, or a single document."""
    offsets = np.cumsum(counts) - counts
    order, at = np.argsort(counts, kind="stable"), 0
    while at < len(order):
        some = order[at : at + most]
        some = some[: max(1, int((np.arange(1, len(some) + 1) * counts[some] <= cells).sum()))]
        at += len(some)
        longest = counts[some].max()
        steps = np.arange(longest)[None]
        mask = steps < counts[some][:, None]
        yield some, np.where(mask, offsets[some][:, None] + steps, 0), mask


def marginals(emission: np.ndarray, mask: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over padded chains: chance of each state, of each pair of neighbouring states (summed), and the log of the partition sums."""
    n, longest, _ = emission.shape
    forward, scale = np.zeros_like(emission), np.zeros((n, longest))
    peak = emission.max(axis=2)
    local = np.exp(emission - peak[:, :, None])
    step = np.exp(transition)
    for t in range(longest):
        now = local[:, t] * (forward[:, t - 1] @ step if t else 1.0)
        total = now.sum(axis=1)
        live = mask[:, t]
        forward[:, t] = np.where(live[:, None], now / total[:, None], forward[:, t - 1] if t else now)
        scale[:, t] = np.where(live, np.log(total) + peak[:, t], 0)
    backward = np.ones_like(emission)
    pairs = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        live = mask[:, t + 1]
        ahead = local[:, t + 1] * backward[:, t + 1]
        value = ahead @ step.T
        pair = forward[:, t][:, :, None] * step[None] * ahead[:, None, :]
        pair /= np.maximum(pair.sum(axis=(1, 2), keepdims=True), 1e-300)
        pairs += pair[live].sum(axis=0)
        backward[:, t] = np.where(live[:, None], value / value.sum(axis=1, keepdims=True), 1.0)
    chance = forward * backward
    return chance / chance.sum(axis=2, keepdims=True), pairs, float(scale.sum())


def train(features: np.ndarray, counts: np.ndarray, labels: np.ndarray, steps: int = STEPS) -> dict:
    """Maximum likelihood with a small ridge; both labels weigh the same, and so do documents of any length."""
    model = {"weights": np.zeros((FEATURES, 2)), "transition": np.zeros((2, 2))}
    if not len(labels):
        return model
    adam = Adam(model, RATE)
    share = np.bincount(labels, minlength=2) / len(labels)
    groups = [(some, at, mask) for some, at, mask in chains(counts)]
    for _ in range(steps):
        weights, transition = 1e-3 * model["weights"], 1e-3 * model["transition"]
        for some, at, mask in groups:
            for label in (0, 1):
                mine = labels[some] == label
                if not mine.any():
                    continue
                x, m = features[at[mine]], mask[mine]
                chance, pairs, _ = marginals(x @ model["weights"], m, model["transition"])
                weight = 1 / (max(share[label], 1e-9) * 2 * len(labels))
                chance[:, :, label] -= 1
                each = m / m.sum(axis=1, keepdims=True)
                weights += weight * np.einsum("ntf,nts->fs", x, chance * each[:, :, None])
                links = max(1, (m.sum(axis=1) - 1).sum())
                pairs[label, label] -= (m.sum(axis=1) - 1).sum()
                transition += weight * mine.sum() * pairs / links
        adam.descend({"weights": weights, "transition": transition})
    return model


def score_texts(model: dict, texts: list[str | None]) -> np.ndarray:
    features, counts, sizes = documents_lines(texts)
    emission = features @ model["weights"]
    out = np.zeros(len(texts))
    for some, at, mask in chains(counts):
        good = marginals(emission[at], mask, model["transition"])[0][:, :, 1]
        weight = np.where(mask, np.maximum(sizes[at], 1), 0)
        out[some] = (good * weight).sum(axis=1) / weight.sum(axis=1)
    return np.clip(out, 0, 1)


def fit(df: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> dict:
    """Train on at most `rows` rows for each label of `labels` (doc_id, label), with the whole texts of `df` (doc_id, text)."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 0):
                features, counts, _ = documents_lines(part.column(0).to_pylist())
                out, at = [], 0
                for n in counts:
                    out.append(features[at : at + n].astype("<f4").tobytes())
                    at += n
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(out, pa.binary())], names=["label", "lines"])

    cost = F.octet_length("text") + LINE_BYTES * (1 + F.regexp_count("text", F.lit("\n")))
    chosen = training_rows(df, labels.where(F.col("label").isin(0, 1)), rows, TRAINING_BYTES, cost).select("text", F.col("label").cast("int").alias("label"))
    found = sorted((r.label, bytes(r.lines)) for r in chosen.mapInArrow(run, "label int, lines binary").collect())  # bounded by rows and bytes
    features = np.frombuffer(b"".join(x for _, x in found), dtype="<f4").reshape(-1, FEATURES).astype(float)
    counts = np.array([len(x) // (4 * FEATURES) for _, x in found], dtype=np.int64)
    return train(features, counts, np.array([y for y, _ in found], dtype=np.int64))


def score(df: DataFrame, model: dict, text: str = "text", name: str = "score") -> DataFrame:
    """Add the quality of every whole text, from 0 to 1."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    return with_column(df, text, name, T.DoubleType(), lambda: lambda texts: pa.array(score_texts(shared.value, texts.to_pylist()), pa.float64()))


def classify(documents: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, threshold: float = 0.7) -> DataFrame:
    """Score `documents` (doc_id, text, ...) with a model of `labels` (doc_id, quality) outside the held-out fold; adds held_out, score, predicted."""
    known = labels.where(fold("doc_id", folds) != held).select("doc_id", F.col("quality").alias("label"))
    model = fit(documents.select("doc_id", "text"), known)
    scored = score(documents, model)
    return scored.withColumns({"held_out": fold("doc_id", folds) == held, "predicted": (F.col("score") >= threshold).cast("int")})
