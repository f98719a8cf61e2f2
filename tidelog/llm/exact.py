"""Exact dedup by deterministic block naming.

Every normalised text is cut into blocks of fixed size. Sorting the blocks gives equal blocks one integer name and different blocks different
ones; then pairs of adjacent names are named in the same way, until each document has a single name. No hash decides: blocks are ordered by
hash only so that ranges are even, and by content where hashes are equal.

A range of the order that holds many equal blocks is split between tasks: each task numbers its own part, and what stands at the edges of the
parts, a few contents per task, is compared afterwards.

Null and empty texts are equal to each other and to texts of white space only. Repeated rows are documents of their own: one of them stays,
among equal ids an arbitrary one. Null ids sort last. Only the id and the text are read, so other columns may have any names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.batches import saved, slices

BLOCK_BYTES = 2048
WHITE = bytes([0x20, *range(0x09, 0x0E)])


def blocks(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = BLOCK_BYTES) -> DataFrame:
    """The blocks of each row: row, n (blocks of the row), idx, key; the first also has doc_id, points (of the original text) and sha."""
    kind = df.schema[doc_id].dataType
    schema = T.StructType().add("row", "long").add("n", "long").add("idx", "long").add("key", "binary").add("doc_id", kind).add("points", "long").add("sha", "string")

    def run(batches):
        for batch in batches:
            for part in slices(batch, 2):
                at, out = [], []
                for i, text in enumerate(part.column(2).to_pylist()):
                    data = (text or "").encode().translate(None, WHITE)
                    n = max(1, -(-len(data) // size))
                    at += [i, *[None] * (n - 1)]
                    first = (len(text or ""), hashlib.sha256(data).hexdigest())
                    row = part.column(0)[i].as_py()
                    out += [(row, n, k, data[k * size : (k + 1) * size], *(first if not k else (None, None))) for k in range(n)]
                row, n, idx, key, points, sha = zip(*out, strict=True)
                ids = part.column(1).take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row, pa.int64()), pa.array(n, pa.int64()), pa.array(idx, pa.int64()), pa.array(key, pa.binary()), ids, pa.array(points, pa.int64()), pa.array(sha, pa.string())],
                    names=schema.names,
                )

    return df.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, schema)


def named(df: DataFrame, salt: list[str]) -> DataFrame:
    """Replace column `key` (binary) by `name`, an integer that is the same for equal keys only. `salt` names columns that tell rows apart."""
    carried = [c for c in df.columns if c != "key"]
    schema = df.select(*carried).schema.add("name", "long").add("edge", "binary")

    def run(batches):
        task = TaskContext.get().partitionId() << 32
        name, hashed, content = task - 1, None, None
        first: dict[bytes, int] | None = None  # contents with the least hash of this part, and those with the last hash so far
        last: dict[bytes, int] = {}
        columns = None
        for batch in batches:
            names = []
            for h, key in zip(batch.column(len(carried) + 1).to_pylist(), batch.column(len(carried)).to_pylist(), strict=True):
                if h != hashed:
                    if first is None and last:
                        first = last
                    hashed, content, last = h, key, {}
                    name += 1
                    last[key] = name
                elif key != content:
                    content = key
                    name += 1
                    last[key] = name
                names.append(name)
            columns = [batch.column(i) for i in range(len(carried))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.int64()), pa.nulls(len(names), pa.binary())], names=schema.names)
        edges = {**(first or {}), **last}
        if edges:
            blank = [pa.nulls(len(edges), c.type) for c in columns]
            yield pa.RecordBatch.from_arrays([*blank, pa.array(edges.values(), pa.int64()), pa.array(edges.keys(), pa.binary())], names=schema.names)

    ordered = (
        df.select(*carried, "key", F.xxhash64("key").alias("_hash"), F.xxhash64(*salt).alias("_salt"))
        .repartitionByRange("_hash", "_salt")
        .sortWithinPartitions("_hash", "key")
    )
    rows = saved(ordered.mapInArrow(run, schema), "names")
    same = rows.where("edge is not null").groupBy("edge").agg(F.min("name").alias("_to"), F.collect_set("name").alias("_names")).where("size(_names) > 1")
    moved = same.select("_to", F.explode("_names").alias("name")).where("name != _to")
    # Two or so contents for each task of the sort.
    return rows.where("edge is null").join(F.broadcast(moved), "name", "left").select(*carried, F.coalesce("_to", "name").alias("name"))


def identities(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of `df`: row, doc_id, points, sha and the identity (level, name), equal for equal normalised texts only."""
    level = named(blocks(df, doc_id, text, size), ["row", "idx"])
    most = level.agg(F.max("n")).first()[0] or 1
    found, k = [], 0
    columns = ["row", "doc_id", "points", "sha"]
    while True:
        found.append(level.where("n = 1").select(*columns, F.lit(k).alias("level"), "name"))
        if most == 1:
            break
        pairs = (
            level.where("n > 1")
            .groupBy("row", F.expr("idx div 2").alias("idx"))
            .agg(
                F.max(F.expr("(n + 1) div 2")).alias("n"),
                F.max(F.when(F.col("idx") % 2 == 0, F.col("name"))).alias("_left"),
                F.max(F.when(F.col("idx") % 2 == 1, F.col("name"))).alias("_right"),
                *[F.max(c).alias(c) for c in columns[1:]],  # only the first block has them
            )
            .withColumn("key", F.concat_ws(":", "_left", F.coalesce("_right", F.lit(-1))).cast("binary"))
            .drop("_left", "_right")
        )
        level, most, k = named(pairs, ["row", "idx"]), (most + 1) // 2, k + 1
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def deduplicate(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `df`: doc_id, keep_id, group_size, kept, text_sha256. Of equal texts the one with most code points, then the smallest id, stays."""
    rows = identities(df, doc_id, text)
    best = F.min(F.struct((-F.col("points")).alias("points"), F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    groups = saved(rows.groupBy("level", "name").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best")).where("group_size > 1"), "groups")
    return rows.join(groups, ["level", "name"], "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("best.row") == F.col("row"), F.lit(True)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
