"""Best-fit packing of token sequences.

Pieces are cut and sorted into runs of equal length, and so are the gaps of open sequences. The sweep goes through the runs from the longest
pieces down: a run of pieces goes to its successor among the gaps, the run of the smallest gaps that hold it; ranks inside the two runs say
which piece gets which gap; what is left over goes on to the next gaps, then to new sequences; the gaps are updated, and the next run follows.
Pieces of one length are interchangeable, so a step of the sweep places any number of them at once. A sweep has at most as many runs as
the capacity has lengths, whatever the number of pieces: it is done on run lengths, and only the ranks and the placement touch the pieces.

Null and empty texts are documents of one token, the separator. Repeated rows are packed each for itself.
"""

from __future__ import annotations

import bisect
import json
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.batches import saved, slices
from tidelog.llm.bpe import WordEncoder
from tidelog.operators.ordered import digest, hash_bucket, with_position
from tidelog.session import local_table


class Tokenizer:
    """Ids as the tokenizers library gives them for a tokenizer file, strings of special tokens being ordinary text.

    In a byte-level file whose ids are the order of its merges, words can be merged by rank, several times faster; any other goes through the
    library as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Library

        self.library = Library.from_file(path)
        self.library.encode_special_tokens = True
        with open(path) as lines:
            self.by_rank = self._ranks(json.load(lines))
        self.words = WordEncoder(self._encode_words, self._encode_text)

    def _ranks(self, file: dict):
        model, split = file["model"], file.get("pre_tokenizer") or {}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
        ranked = all(model["vocab"].get(a + b) == i for i, (a, b) in enumerate(merges, 256))
        if not ranked or file.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            return None
        import public_tokenizers
        import tiktoken

        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in such a file; the others follow 255
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if i < 256 + len(merges)}
        self.lengths = np.zeros(len(ranks), dtype=np.int64)
        for token, i in ranks.items():
            self.lengths[i] = len(token)
        return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _encode_text(self, text: str) -> bytes:
        ids = self.by_rank.encode_ordinary(text) if self.by_rank else self.library.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Encode many words, each with a space before it, in one call and cut the ids at the words' ends."""
        ids = np.array(self.by_rank.encode_ordinary(" " + " ".join(words)), dtype="<u4")
        ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(w.encode()) + 1 for w in words]), side="left") + 1
        data = ids.tobytes()
        return [data[4 * a : 4 * b] for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if self.by_rank:
            return self.words.encode(texts)
        found = self.library.encode_batch([t or "" for t in texts], add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]


def cut(ids: bytes, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece in ids; all but the first are full."""
    n = len(ids) // 4
    head = n % capacity or min(n, capacity)
    return [(0, head), *((s, capacity) for s in range(head, n, capacity))]


def pieces(df: DataFrame, tokenizer: str, capacity: int, doc_id: str = "doc_id", text: str = "text", separator: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length and ids, little-endian unsigned 32-bit integers."""
    schema = T.StructType(
        [
            T.StructField("doc_id", df.schema[doc_id].dataType),
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )
    end = np.array([separator], dtype="<u4").tobytes()

    def run(batches):
        encoder = None
        for batch in batches:
            for part in slices(batch, 1):
                encoder = encoder or Tokenizer(tokenizer)
                rows, at = [], []
                for i, ids in enumerate(encoder.encode(part.column(1).to_pylist())):
                    whole = ids + end
                    for k, (start, length) in enumerate(cut(whole, capacity)):
                        at.append(i)
                        rows.append((k, start, length, whole[4 * start : 4 * (start + length)]))
                columns = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), *columns], names=schema.names)

    return df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, schema)


def sweep(counts: dict[int, int], capacity: int) -> list[dict]:
    """Place runs of equal pieces into runs of equal gaps, best fit first, longest pieces first.

    Each step says: the pieces of `length` with ranks from `rank_from` up to `rank_to` go to sequences from `sequence_from` on, `each` to a
    sequence, the first of a sequence at `offset`.
    """
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)
    sizes: list[int] = []
    steps: list[dict] = []
    opened = 0

    def give(gap: int, first: int, n: int) -> None:
        if n and gap:
            if not gaps[gap]:
                bisect.insort(sizes, gap)
            gaps[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0

        def place(gap: int, first: int, n: int, length: int = length) -> None:
            """Fill n gaps as far as pieces of the run are left."""
            nonlocal left, rank
            each = gap // length
            full = min(n, left // each)
            rest = min(left - full * each, each) if full < n else 0
            used = full * each + rest
            steps.append({"length": length, "rank_from": rank, "rank_to": rank + used, "sequence_from": first, "each": each, "offset": capacity - gap})
            left, rank = left - used, rank + used
            give(gap - each * length, first, full)
            if rest:
                give(gap - rest * length, first + full, 1)
            give(gap, first + full + bool(rest), n - full - bool(rest))

        while left:
            at = bisect.bisect_left(sizes, length)
            if at == len(sizes):
                n = -(-left // (capacity // length))
                place(capacity, opened, n)
                opened += n
                continue
            gap = sizes.pop(at)
            runs, gaps[gap] = gaps[gap], []
            for k, (first, n) in enumerate(runs):
                if not left:
                    for first_left, n_left in runs[k:]:
                        give(gap, first_left, n_left)
                    break
                place(gap, first, n)
    return steps


STEP = "length bigint, rank_from bigint, rank_to bigint, sequence_from bigint, each bigint, offset bigint"


def pack(rows: DataFrame, capacity: int, order: list[str], length: str = "length") -> DataFrame:
    """Add sequence_id and offset to every row: sequences of at most `capacity`, gapless from 0. Lengths are from 1 to `capacity`.

    `order` names columns that rank rows of equal length; ties among them are repeated rows, which take different places.
    """
    spark = rows.sparkSession
    kept = saved(rows.withColumns({"_length": F.col(length).cast("long")}), "pack")
    counts = {r[0]: r[1] for r in kept.groupBy("_length").count().collect()}  # at most one row per length
    bad = [n for n in counts if n is None or not 0 < n <= capacity]
    if bad:
        raise ValueError(f"lengths outside 1..{capacity}: {bad[:5]}")
    steps = local_table(spark, sweep(counts, capacity), STEP).select(*[F.col(c).alias(f"_s_{c}") for c in STEP.replace(" bigint", "").split(", ")])
    key = digest(*[F.col(c).cast("string") for c in order])
    ranked = with_position(kept, ["_length"], order, hash_bucket(key), "_rank", "_total")
    inside = F.col("_rank") - F.col("_s_rank_from")
    return (
        # Steps are bounded by the capacity: each length splits at most two runs of gaps, and a gap is halved each time it is used.
        ranked.join(F.broadcast(steps), (F.col("_length") == F.col("_s_length")) & (F.col("_rank") >= F.col("_s_rank_from")) & (F.col("_rank") < F.col("_s_rank_to")))
        .withColumn("sequence_id", F.col("_s_sequence_from") + F.expr("(_rank - _s_rank_from) div _s_each"))
        .withColumn("offset", F.col("_s_offset") + F.pmod(inside, F.col("_s_each")) * F.col("_length"))
        .select(*[c for c in rows.columns if c not in ("sequence_id", "offset")], "sequence_id", "offset")
    )


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id and ids. A sequence holds at most `capacity` tokens, so its group is bounded."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("_parts")).select("sequence_id", F.expr("aggregate(_parts, cast('' as binary), (a, p) -> concat(a, p.ids))").alias("ids"))
