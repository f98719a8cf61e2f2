"""Filter interaction audit over a sparse document-term matrix.

Texts are gathered into shards. A shard counts its words under numbers of its own and lists each different word once, by bucket of its checksum; a bucket
sorts and numbers the words of all shards, which makes the global dictionary, and each shard's numbers are then replaced by global ones. A shard is a matrix in
compressed sparse rows: `indptr` (where a document's entries start), `indices` (word numbers) and `counts`. Row sums are a document's words,
numbers of entries its different words; these decide the two filters on words. The other filters' flags come with the shard or by a join.

A word travels once per shard, however frequent it is. Copies are found by 128-bit digests of whole texts, grouped before they are joined.
The audit itself needs only counts by part and set of failed filters, at most 2^filters for each part.

Words are maximal runs of bytes outside [\\x20\\x09-\\x0D], compared with case. Null texts count as empty; an empty text has no words, fails the
filter on length and no other, unless it repeats a smaller id's. Null ids are larger than all others and have no labels. Rows stored again are
documents of their own, and equal ids are not smaller than each other. Of several labels of one id any 1 counts. Null parts are the empty string. An empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.batches import saved, slices
from tidelog.llm.exchange import ROWS, grouped, meet, planes, rows_out, unplanes

LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SIGNS = 100, 80, 10, "#$%&*|"
#: Bytes of text in a shard; words that a bucket of the dictionary lists on average.
SHARD_BYTES, BUCKET_WORDS = 4_000_000, 250_000


class Vocabulary(dict):
    """Numbers words as they come."""

    def __missing__(self, word):
        self[word] = number = len(self)
        return number


def matrix_rows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """indptr, indices, counts and words of some texts."""
    vocabulary = Vocabulary()
    numbered = [np.fromiter(map(vocabulary.__getitem__, t.split()), dtype=np.int32) for t in texts]  # one text's words at a time
    sizes, numbers = np.array([len(n) for n in numbered]), np.concatenate(numbered)
    entries, counts = np.unique((np.repeat(np.arange(len(texts)), sizes) << 32) | numbers, return_counts=True)
    indptr = np.searchsorted(entries >> 32, np.arange(len(texts) + 1))
    return indptr.astype(np.int32), (entries & 0xFFFFFFFF).astype(np.int32), counts.astype(np.int32), list(vocabulary)


def flagged(texts: pa.Array, capital_percent: int, signs: str) -> tuple[np.ndarray, np.ndarray]:
    """Whether more than `capital_percent` of a text's code points are capitals A to Z, and whether it holds any of the signs."""
    offsets = np.frombuffer(texts.buffers()[1], "<i8")[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]

    def count(kind: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(kind[data])])[offsets - offsets[0]])

    byte = np.arange(256)
    capitals, points = count((byte >= 65) & (byte <= 90)), count((byte & 0xC0) != 0x80)
    return 100 * capitals > capital_percent * points, count(np.isin(byte, list(signs.encode()))) > 0


def shards(df: DataFrame, capital_percent: int, signs: str, size: int, buckets: int) -> DataFrame:
    """Shards of (doc_id, part, text): the matrix under numbers of its own, its documents, and its words by bucket, in the order of these numbers."""

    def run(batches):
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch, 2, size):
                texts = part.column(2).cast(pa.large_binary())
                plain = texts.to_pylist()
                capitals, marked = flagged(texts, capital_percent, signs)
                indptr, indices, counts, words = matrix_rows(plain)
                digests = [hashlib.blake2b(t, digest_size=16).digest() for t in plain]
                docs = pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(capitals), pa.array(marked), pa.array(digests, pa.binary(16))], names=DOCS)
                # Words by bucket, sorted inside it.
                bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), dtype=np.int64, count=len(words))
                order = sorted(range(len(words)), key=words.__getitem__)
                order = np.array(order, dtype=np.int64)[np.argsort(bucket[order], kind="stable")] if words else bucket
                place = np.empty(len(words), dtype=np.int32)
                place[order] = np.arange(len(words))
                rows = [(number, -1, docs.serialize().to_pybytes(), planes(indptr), planes(place[indices]), planes(counts))]
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                listed = [words[i] for i in order]
                rows += [(number, b, b" ".join(listed[cuts[b] : cuts[b + 1]]), b"", b"", b"") for b in np.flatnonzero(np.diff(cuts)).tolist()]
                yield rows_out(rows)
                number += 1

    return df.mapInArrow(run, ROWS)


DOCS = ["doc_id", "part", "capitals", "signs", "digest"]


def numbers(group: list[dict]):
    """Of one bucket of the dictionary: the numbers of each shard's words, and (slice -1) the different words in the order of their numbers."""
    lists = [r["a"].split(b" ") for r in group]
    words = sorted(set().union(*lists))
    number = dict(zip(words, range(group[0]["bucket"] << 40, (group[0]["bucket"] << 40) + len(words)), strict=True))
    out = [(r["slice"], r["bucket"], planes(np.fromiter(map(number.__getitem__, x), dtype=np.int64, count=len(x))), b"", b"", b"") for r, x in zip(group, lists, strict=True)]
    yield rows_out([*out, (-1, group[0]["bucket"], b" ".join(words), b"", b"", b"")])


def encoded(group: list[dict]):
    """A shard with global word numbers."""
    row, of = group[0], [unplanes(r["a"]) for r in group[1:]]
    indices = np.concatenate(of)[unplanes(row["c"])] if of else np.zeros(0, dtype=np.int64)
    yield rows_out([(row["slice"], -1, row["a"], row["b"], planes(indices), row["d"])])


def document_term_matrix(df: DataFrame, capital_percent: int = CAPITAL_PERCENT, signs: str = SIGNS, size: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """The matrix of (doc_id, part, text) in shards: documents (a), indptr (b), indices (c) and counts (d) as planes of 64-bit integers; and the dictionary:
    per bucket the words (a) whose numbers count up from bucket * 2^40."""
    # A text has about one word that its shard has not met in 16 bytes, at most.
    total = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, total // 16 // BUCKET_WORDS)
    local = saved(shards(df, capital_percent, signs, size, buckets), "shards")
    said = saved(meet(local.where("bucket >= 0"), "bucket", "slice", numbers), "word_numbers")
    return meet(local.where("bucket < 0").unionAll(said.where("slice >= 0")), "slice", "bucket", encoded), said.where("slice < 0")


def word_counts(matrix: DataFrame) -> DataFrame:
    """Per document of the matrix: doc_id, part, capitals, signs, digest, n_words (row sum) and n_distinct (entries)."""

    def run(batches):
        for (row,) in grouped(batches, "slice"):
            docs = pa.ipc.read_record_batch(pa.py_buffer(row["a"]), DOCS_SCHEMA)
            indptr = unplanes(row["b"])
            total = np.concatenate([[0], np.cumsum(unplanes(row["d"]))])
            columns = [*docs.columns[:4], docs.column(4).cast(pa.binary()), pa.array(np.diff(total[indptr]), pa.int64()), pa.array(np.diff(indptr), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*DOCS, "n_words", "n_distinct"])

    return matrix.mapInArrow(run, "doc_id long, part string, capitals boolean, signs boolean, digest binary, n_words long, n_distinct long")


DOCS_SCHEMA = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("capitals", pa.bool_()), ("signs", pa.bool_()), ("digest", pa.binary(16))])


def failures(df: DataFrame, part: str, least_words: int = LEAST_WORDS, distinct_percent: int = DISTINCT_PERCENT, capital_percent: int = CAPITAL_PERCENT, signs: str = SIGNS) -> DataFrame:
    """Per row of `df` (doc_id, text, `part`): doc_id, part, n_words, n_distinct and which of the filters A to E fail it."""
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    matrix, _ = document_term_matrix(docs, capital_percent, signs)
    # Written, so that a hot digest's rows can be split between tasks of the join.
    counted = saved(word_counts(matrix), "word_counts")
    first = counted.groupBy("digest").agg(F.min("doc_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("digest", "_first")
    joined = counted.join(saved(first, "first_copies"), "digest", "left")
    later = F.col("_first").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("_first")))
    return joined.select(
        "doc_id", "part", "n_words", "n_distinct",
        (F.col("n_words") < least_words).alias("A"),
        (100 * F.col("n_distinct") < distinct_percent * F.col("n_words")).alias("B"),
        F.col("capitals").alias("C"), F.col("signs").alias("D"), later.alias("E"),
    )


def total(cells: Column, what: str, keep) -> Column:
    return F.aggregate(F.filter(cells, keep), F.lit(0).cast("long"), lambda s, c: s + c[what])


def interactions(failed: DataFrame, labels: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """Every order of the filters, applied left to right, for each part of `failed` (doc_id, part, a boolean per filter) with `labels` (doc_id, quality,
    toxic): part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    known = labels.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    mask = sum((F.when(F.col(f), 1 << i).otherwise(0) for i, f in enumerate(filters)), F.lit(0))
    rows = failed.select("doc_id", "part", mask.alias("mask")).join(known, F.col("doc_id") == F.col("_id"), "left")
    counted = rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    cells = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # at most 2^filters
    steps = [
        {"filter_order": "".join(order), "step": k + 1, "before": sum(1 << filters.index(f) for f in order[:k]), "bit": 1 << filters.index(f)}
        for order in itertools.permutations(filters)
        for k, f in enumerate(order)
    ]
    literal = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, before: int, bit: int>>")
    each = cells.select("part", "cells", F.explode(literal).alias("s")).select("part", "cells", "s.*")

    def hit(c):
        return (c.mask.bitwiseAND(F.col("bit")) != 0) & (c.mask.bitwiseAND(F.col("before")) == 0)

    # Of all orders, an equal share has each of a document's failed filters first.
    share = F.aggregate(
        F.filter("cells", lambda c: c.mask.bitwiseAND(F.col("bit")) != 0),
        F.lit(0).cast("long"),
        lambda s, c: s + (c.n * math.factorial(len(filters)) / F.bit_count(c.mask)).cast("long"),
    )
    return each.select(
        "part", "filter_order", "step",
        total("cells", "n", lambda c: c.mask.bitwiseAND(F.col("before").bitwiseOR(F.col("bit"))) == 0).alias("kept"),
        total("cells", "n", hit).alias("removed"),
        total("cells", "n", lambda c: (c.mask.bitwiseAND(F.col("bit")) != 0) & (c.mask.bitwiseAND(F.col("before")) != 0)).alias("redundant"),
        total("cells", "n", lambda c: c.mask == F.col("bit")).alias("unique_fails"),
        total("cells", "good", hit).alias("good_lost"),
        total("cells", "toxic", hit).alias("toxic_lost"),
        share.alias("shapley"),
    )
