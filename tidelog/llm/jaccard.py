"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

Documents are sets of shingles of five lower-cased words. Documents with equal sets collapse into one representative. Each tree of the forest
orders the representatives by a MinHash signature of its own; documents that share a prefix of it are candidates. The prefix starts at its full
length and is shortened until a pair at the threshold meets in some tree with the target chance. Prefixes with equal members in several trees
count once.

The members of a prefix are cut into blocks of bounded size; a task gets two blocks and the texts of their members, and verifies all pairs
between them that no earlier tree has brought together. It returns, per member, the number of links and one link of a spanning forest, never the
pairs. So a pair is counted once, and the rows returned grow with the members.

A document without words has no shingles and no links; one of fewer than five words has a single shingle, all its words. Null texts count
as empty. Shingles are compared by 64-bit hashes. Repeated rows link to each other. Only the id and the text are read, so other columns may have
any names. Null ids are documents like others and sort last.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.batches import saved, slices

WORDS, THRESHOLD, TREES, DEPTH, TARGET = 5, 0.8, 16, 8, 0.9999
BLOCK_ROWS, CACHED_WORDS = 256, 300_000


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers (multiply and shift)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Sorted distinct 64-bit hashes of the shingles of a text."""

    def __init__(self, words: int = WORDS):
        self.words, self.known = words, {}

    def __call__(self, text: str | None) -> np.ndarray:
        found, known = (text or "").lower().split(), self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        ids = []
        for w in found:
            value = known.get(w)
            if value is None:
                value = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                if len(w) < 100:
                    known[w] = value
            ids.append(value)
        hashes = np.array(ids, dtype=np.uint64)
        n = max(1, len(hashes) - self.words + 1) if len(hashes) else 0
        out = np.zeros(n, dtype=np.uint64)
        for k in range(min(self.words, len(hashes))):
            out = mix(out + hashes[k : k + n])
        return np.unique(out)


def prefix_length(threshold: float, trees: int, depth: int, target: float) -> int:
    """The longest prefix with which a pair at the threshold meets in one of the trees with the target chance."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < target:
        depth -= 1
    return depth


class Forest:
    """A key per tree: the hash of the prefix of the tree's MinHash signature."""

    def __init__(self, trees: int, length: int, seed: int = 7):
        random = np.random.default_rng(seed)
        self.trees, self.length = trees, length
        self.factors = random.integers(1, 1 << 63, trees * length, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def keys(self, shingles: np.ndarray) -> list[int]:
        least = np.full(self.trees * self.length, np.iinfo(np.uint64).max, dtype=np.uint64)
        for at in range(0, len(shingles), 2_000):
            least = np.minimum(least, mix(shingles[at : at + 2_000, None] * self.factors[None]).min(axis=0))
        out = np.arange(1, self.trees + 1, dtype=np.uint64)
        for k in range(self.length):
            out = mix(out + least.reshape(self.trees, self.length)[:, k])
        return out.view(np.int64).tolist()


def sketches(df: DataFrame, forest: Forest, words: int) -> DataFrame:
    """Per row of (doc_id, text_hash, text): doc_id, text_hash, same (digest of the shingle set, null if empty) and the keys of the trees."""
    schema = df.select("doc_id", "text_hash").schema.add("same", "binary").add("keys", T.ArrayType(T.LongType()))

    def run(batches):
        shingler = Shingler(words)
        for batch in batches:
            for part in slices(batch, 2):
                same, keys = [], []
                for text in part.column(2).to_pylist():
                    shingles = shingler(text)
                    same.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None)
                    keys.append(forest.keys(shingles) if len(shingles) else [])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(same, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=schema.names)

    return df.select("doc_id", "text_hash", "text").mapInArrow(run, schema)


def linked(sets: list[np.ndarray], keys: np.ndarray, tree: int, threshold: float, split: int) -> np.ndarray:
    """Which members are linked, as a symmetric matrix of booleans.

    With `split`, only members before it with members from it on. Pairs that an earlier tree brings together too are left out.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    of = np.repeat(np.arange(n), sizes)
    often = np.bincount(codes) > 1
    wanted = often[codes]
    column, of = (np.cumsum(often) - 1)[codes[wanted]], of[wanted]
    shared = np.zeros((n, n))
    order = np.argsort(column, kind="stable")
    column, of = column[order], of[order]
    for first in range(0, int(often.sum()), 4_096):
        a, b = np.searchsorted(column, [first, first + 4_096])
        block = np.zeros((n, 4_096), dtype=np.float32)
        block[of[a:b], column[a:b] - first] = 1
        shared += block @ block.T
    out = shared >= threshold * (sizes[:, None] + sizes[None] - shared) - 1e-9
    np.fill_diagonal(out, False)
    if split:
        out[:split, :split] = False
        out[split:, split:] = False
    for t in range(tree):
        out &= keys[:, None, t] != keys[None, :, t]
    return out


def roots(matrix: np.ndarray) -> np.ndarray:
    """For each member the first member of its connected part."""
    label = np.arange(len(matrix))
    while True:
        reach = np.where(matrix, label[None], len(label)).min(axis=1)
        new = np.minimum(label, reach)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def verify(rows: list[dict], shingler: Shingler, threshold: float) -> list[tuple[int, int, int]]:
    """Links of one pair of blocks: (member, links weighted by copies, a member it is connected with)."""
    members = {r["rep"]: r for r in rows}
    ordered = sorted(members.values(), key=lambda r: (r["block"], r["rep"]))
    if len(ordered) < 2:
        return []
    first, other = ordered[0]["one"], ordered[0]["two"]
    split = sum(r["block"] == first for r in ordered) if first != other else 0
    if first != other and split in (0, len(ordered)):
        return []
    sets = [shingler(r["text"]) for r in ordered]
    weights = np.array([r["weight"] for r in ordered])
    matrix = linked(sets, np.array([r["keys"] for r in ordered]), ordered[0]["tree"], threshold, split)
    links, root = matrix @ weights, roots(matrix)
    return [(ordered[i]["rep"], int(links[i]), ordered[root[i]]["rep"]) for i in np.flatnonzero(links)]


MEMBER = ["key", "tree", "one", "two", "block", "rep", "weight", "keys", "text"]


def verified(members: DataFrame, threshold: float, words: int) -> DataFrame:
    """Links of members that lie group by group in each partition: rep, links, root."""

    def run(batches):
        shingler, group, rows = Shingler(words), None, []

        def close():
            out = verify(rows, shingler, threshold) if rows else []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["rep", "links", "root"])

        for batch in batches:
            for row in batch.to_pylist():
                here = (row["key"], row["tree"], row["one"], row["two"])
                if here != group:
                    yield from close()
                    group, rows = here, []
                rows.append(row)
        yield from close()

    return members.select(*MEMBER).mapInArrow(run, "rep long, links long, root long")


def components(edges: DataFrame) -> DataFrame:
    """Smallest member of each connected part: node, label. Labels spread over links and jump to their labels' labels until nothing changes."""
    both = saved(edges.where("a != b").select("a", "b").unionAll(edges.where("a != b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = saved(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        spread = saved(labels.join(near, labels.node == near.a).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), "labels")
        jump = spread.select(F.col("node").alias("label"), F.col("label").alias("far"))
        after = saved(spread.join(jump, "label").select("node", "old", F.least("label", "far").alias("label")), "labels")
        labels = after.select("node", "label")
        if after.where("old != label").isEmpty():
            return labels


def join(df: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, trees: int = TREES, depth: int = DEPTH, target: float = TARGET, block: int = BLOCK_ROWS) -> DataFrame:
    """One row per row of `df` (doc_id, text): doc_id, class_id (the smallest id connected with it by links) and n_links, the number of other
    rows with a similarity of at least `threshold`."""
    forest = Forest(trees, prefix_length(threshold, trees, depth, target))
    docs = df.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    known = saved(sketches(docs, forest, words), "sketches")
    some = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    kinds = known.where("same is not null").groupBy("same").agg(some.alias("_rep"), F.count(F.lit(1)).alias("weight"), F.first("keys").alias("keys"))
    # Representatives by number, in the order of their ids.
    order = kinds.select("same", "weight", "keys", "_rep.none", "_rep.doc_id", "_rep.text_hash").repartitionByRange("none", "doc_id", "text_hash").sortWithinPartitions("none", "doc_id", "text_hash")
    sets = saved(order.withColumn("rep", F.monotonically_increasing_id()), "sets")

    placed = sets.select("rep", F.posexplode("keys").alias("tree", "key"))
    prefixes = placed.groupBy("tree", "key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("rep")).alias("_x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("_y")).where("n > 1")
    once = prefixes.groupBy("n", "_x", "_y").agg(F.min(F.struct("tree", "key")).alias("_g"))
    groups = saved(once.select("_g.tree", "_g.key", F.expr(f"(n + {block - 1}) div {block}").alias("blocks")), "prefixes")
    inside = saved(placed.join(groups, ["tree", "key"]), "members")
    mine = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    paired = inside.withColumn("block", mine).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("_other"))
    paired = paired.withColumns({"one": F.least("block", "_other"), "two": F.greatest("block", "_other")}).drop("_other", "blocks")

    needed = sets.join(inside.select("rep").distinct(), "rep", "left_semi").select("rep", "weight", "keys", "doc_id", "text_hash")
    texts = docs.join(needed.hint("shuffle_hash"), docs.doc_id.eqNullSafe(needed.doc_id) & (docs.text_hash == needed.text_hash)).select("rep", "weight", "keys", "text")
    members = paired.join(texts, "rep").repartition("key", "tree", "one", "two").sortWithinPartitions("key", "tree", "one", "two")
    links = saved(verified(members, threshold, words), "links")

    labels = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    per_rep = links.groupBy("rep").agg(F.sum("links").alias("links")).join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    linked_sets = sets.select("rep", "same", "weight", "doc_id").join(per_rep, "rep", "left")
    ids = sets.select(F.col("rep").alias("label"), F.col("doc_id").alias("class_id"))
    resolved = linked_sets.withColumn("label", F.coalesce("label", "rep")).join(ids, "label").select("same", "class_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = known.select("doc_id", "same").join(saved(resolved, "classes"), "same", "left")
    return out.select("doc_id", F.when(F.col("n_links").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
