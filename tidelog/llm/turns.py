"""Conversation prefix trie by fixed-length block hashing.

Turns are told apart by 128-bit digests of role and text. A conversation is cut into blocks of `BLOCK` turns, blocks of blocks and so on, as many levels
as the longest one needs. Digests go up, block by block; the identity of the prefix before a block comes down, from the prefix before the block above and the
digests of the blocks between. So equal prefixes have equal identities, and no step holds more than `BLOCK` members, however long a conversation is.

Conversations are grouped by (prefix, block) first: what they share in whole blocks is one row from there on. Turn boundaries are
refined, and grouped again, only where blocks that follow the same prefix differ; where they do not, the block's nodes have its members.

A node is named by its smallest member and its depth. The nodes of one smallest member are a path, so the trie is a tree of paths; sums over
subtrees go path by path, from those that nothing branches off to those they branch off from, and then along each path in bounded pieces. The number of rounds
is that of paths nested in each other.

Turns are ordered by `turn`, nulls first, equal ones by content. Null roles and texts count as empty. Rows without a conv_id belong to no
conversation. Rows stored again are turns of their own. An empty table gives no rows, not even a root. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.batches import saved

BLOCK, PIECE, JOINED_IDS = 8, 4096, 10_000
ROOT = hashlib.md5(b"").hexdigest()


def numbered(df: DataFrame) -> DataFrame:
    """Turns of `df` (conv_id, turn, role, text) with their place: conv_id, i (from 0), n (turns of the conversation), digest, n_bytes.

    Places follow from the sorted order of the whole table, so that a very long conversation spreads over tasks."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    rows = df.where("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("_tie"))
    order = ["conv_id", F.asc_nulls_first("turn"), "digest", "_tie"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = saved(ordered.select("conv_id", "digest", "n_bytes", F.monotonically_increasing_id().alias("place")), "turns")
    part = F.shiftright("place", 33).alias("part")
    cells = placed.groupBy("conv_id", part).agg(F.min("place").alias("low"), F.count(F.lit(1)).alias("rows"))
    whole = Window.partitionBy("conv_id")  # at most one row per task
    before = F.coalesce(F.sum("rows").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = cells.select("conv_id", "part", (before - F.col("low")).alias("shift"), F.sum("rows").over(whole).alias("n"))
    return placed.withColumn("part", part).join(shifts, ["conv_id", "part"]).select("conv_id", (F.col("place") + F.col("shift")).alias("i"), "n", "digest", "n_bytes")


def rebuilt(df: DataFrame, family: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first h turns are those of the first of their family, h being a checksum of the id modulo `heads`.

    Returns turns (conv_id, t from 0, digest, n_bytes, length) and conversations (conv_id, length), both written."""
    turns = saved(numbered(df), "numbered")
    ids = turns.where("i = 0").select("conv_id", "n")
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).alias("h")
    base = (F.col("conv_id") - F.col("conv_id") % family).alias("base")
    known = ids.select(F.col("conv_id").alias("base"), F.col("n").alias("_base_n"))
    convs = ids.select("conv_id", "n", h, base).join(known, "base", "left")
    taken = F.least("h", F.coalesce("_base_n", F.lit(0)))
    convs = saved(convs.select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "conversations")
    own = turns.drop("n").join(convs.drop("base"), "conv_id").where("i >= h").select("conv_id", (F.col("taken") + F.col("i") - F.col("h")).alias("t"), "digest", "n_bytes", "length")
    first = turns.where((F.col("i") < heads - 1) & (F.col("conv_id") % family == 0)).select(F.col("conv_id").alias("base"), "i", "digest", "n_bytes")
    shared = first.join(convs, "base").where("i < h").select("conv_id", F.col("i").alias("t"), "digest", "n_bytes", "length")
    return saved(own.unionAll(shared), "rebuilt"), convs.select("conv_id", "length")


def after(start: Column, digests: Column, count: Column) -> Column:
    """Identity of a prefix followed by the first `count` of some blocks or turns."""
    return F.when(count == 0, start).otherwise(F.md5(F.concat(start, F.array_join(F.slice(digests, 1, count), ""))))


def blocks(turns: DataFrame, block: int) -> DataFrame:
    """conv_id, length, items (t, digest, n_bytes) and ids, the identities of the prefixes before each item and after the last."""
    at = F.expr(f"t div {block}").alias("b")
    table = turns.groupBy("conv_id", at).agg(F.sort_array(F.collect_list(F.struct("t", "digest", "n_bytes"))).alias("items"), F.first("length").alias("length"))
    levels = [saved(table, "blocks")]
    longest = turns.agg(F.max("length")).first()[0] or 0
    while block ** len(levels) <= longest:
        below = levels[-1].select("conv_id", F.expr(f"b div {block}").alias("up"), F.struct("b", F.md5(F.array_join("items.digest", "")).alias("digest")).alias("item"))
        levels.append(saved(below.groupBy("conv_id", "up").agg(F.sort_array(F.collect_list("item")).alias("items")).withColumnRenamed("up", "b"), "blocks_above"))
    # The topmost level has one block per conversation, which is never full.
    known = levels.pop().withColumns({"start": F.lit(ROOT), "next": F.lit(None).cast("string")})
    while levels:
        digests = F.col("items.digest")
        kids = known.select("conv_id", "start", "next", "items", F.posexplode("items").alias("j", "item"))
        following = F.when(F.col("j") + 1 == block, F.col("next")).otherwise(after(F.col("start"), digests, F.col("j") + 1))
        told = kids.select("conv_id", F.col("item.b").alias("b"), after(F.col("start"), digests, F.col("j")).alias("start"), following.alias("next"))
        known = levels.pop().join(told, ["conv_id", "b"])
    size = F.size("items")
    ids = F.transform(F.sequence(F.lit(0), size), lambda j: F.when(j == block, F.col("next")).otherwise(after(F.col("start"), F.col("items.digest"), j)))
    return known.select("conv_id", "length", "items", ids.alias("ids"))


def members(turns: DataFrame, convs: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Nodes below the root (id, parent, depth, conv_id, n_convs, n_bytes of the last text), and where each conversation ends (id, conv_id)."""
    placed = saved(blocks(turns, block), "prefixes")
    last = F.element_at("items", -1)
    ends = placed.where(last.t + 1 == F.col("length")).select(F.element_at("ids", -1).alias("id"), "conv_id")
    ends = ends.unionAll(convs.where("length = 0").select(F.lit(ROOT).alias("id"), "conv_id"))
    # Whole blocks first: conversations with equal prefix and block are one row from here on.
    content = F.md5(F.concat_ws("", "items.digest"))
    same = placed.groupBy(F.element_at("ids", 1).alias("start"), content.alias("content")).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("items").alias("items"), F.first("ids").alias("ids")
    )
    same = saved(same, "distinct_blocks")
    forked = same.groupBy("start").agg((F.min("content") != F.max("content")).alias("forked"))
    rows = same.join(saved(forked, "forks"), "start").select("conv_id", "n_convs", "ids", "forked", F.posexplode("items").alias("j", "item"))
    parent, child = F.element_at("ids", F.col("j") + 1), F.element_at("ids", F.col("j") + 2)
    edges = rows.select(child.alias("id"), parent.alias("parent"), (F.col("item.t") + 1).alias("depth"), "conv_id", "n_convs", F.col("item.n_bytes").alias("n_bytes"), "forked")
    whole = edges.where("not forked").drop("forked")
    refined = edges.where("forked").groupBy("id", "parent", "depth").agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.first("n_bytes").alias("n_bytes"))
    return whole.unionAll(refined.select(*whole.columns)), ends


def joined_digests(ends: DataFrame) -> DataFrame:
    """Per node where conversations end: id and ends_sha256, of their ids in ascending order joined by commas.

    Ids are joined in pieces by many tasks; the hash, sequential by nature, reads the pieces one after the other and holds one."""

    def pieces(batches):
        here, first, held = None, None, []

        def close():
            return pa.RecordBatch.from_arrays([pa.array([here], pa.string()), pa.array([first], pa.int64()), pa.array([",".join(map(str, held))], pa.string())], names=["id", "first", "ids"])

        for batch in batches:
            for node, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if node != here or len(held) >= JOINED_IDS:
                    if held:
                        yield close()
                    here, first, held = node, conv, []
                held.append(conv)
        if held:
            yield close()

    def hashes(batches):
        here, state = None, None

        def close():
            return pa.RecordBatch.from_arrays([pa.array([here], pa.string()), pa.array([state.hexdigest()], pa.string())], names=["id", "ends_sha256"])

        for batch in batches:
            for node, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if node != here:
                    if state:
                        yield close()
                    here, state = node, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if state:
            yield close()

    ordered = ends.select("id", "conv_id").repartitionByRange("id", "conv_id").sortWithinPartitions("id", "conv_id").mapInArrow(pieces, "id string, first long, ids string")
    return ordered.repartition("id").sortWithinPartitions("id", "first").mapInArrow(hashes, "id string, ends_sha256 string")


def path_totals(paths: DataFrame) -> DataFrame:
    """Totals of paths with all that branches off below: `paths` (conv_id, up, up_depth, leaves, tokens) with leaves and tokens summed.

    Each round settles the paths that nothing unsettled branches off from and adds them to the paths above."""
    live, settled = saved(paths, "paths"), None
    while True:
        waited = live.where("up is not null").select(F.col("up").alias("conv_id")).distinct()
        done = live.join(waited, "conv_id", "left_anti")
        settled = done if settled is None else settled.unionAll(done)
        sent = done.where("up is not null").groupBy(F.col("up").alias("conv_id")).agg(F.sum("leaves").alias("_leaves"), F.sum("tokens").alias("_tokens"))
        rest = live.join(waited, "conv_id", "left_semi").join(sent, "conv_id", "left")
        rest = rest.select("conv_id", "up", "up_depth", *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in ("leaves", "tokens")])
        live = saved(rest, "paths")
        if live.isEmpty():
            return settled


def along(df: DataFrame, columns: list[str], piece: int) -> DataFrame:
    """Sums of columns from each depth to the end of its path, in pieces of bounded length."""
    cut = df.withColumn("_piece", F.expr(f"depth div {piece}"))
    later = Window.partitionBy("conv_id").orderBy(F.desc("_piece")).rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy("conv_id", "_piece").agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    totals = totals.select("conv_id", "_piece", *[F.coalesce(F.sum(f"_{c}").over(later), F.lit(0)).alias(f"_{c}") for c in columns])
    inside = Window.partitionBy("conv_id", "_piece").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = cut.withColumns({c: F.sum(c).over(inside) for c in columns}).join(totals, ["conv_id", "_piece"])
    return summed.withColumns({c: F.col(c) + F.col(f"_{c}") for c in columns}).drop("_piece", *[f"_{c}" for c in columns])


def prefix_trie(turns: DataFrame, convs: DataFrame, block: int = BLOCK, piece: int = PIECE) -> DataFrame:
    """Nodes of the trie of `turns` (conv_id, t, digest, n_bytes, length) of conversations (conv_id, length): conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256."""
    below, ends = members(turns, convs, block)
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = top.select(F.lit(ROOT).alias("id"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("long").alias("n_bytes"))
    nodes = saved(below.unionAll(root), "nodes")

    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    names = nodes.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    full = nodes.join(names, "parent", "left").join(children, "id", "left").join(joined_digests(ends), "id", "left")
    full = saved(
        full.select(
            "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
            F.col("n_children").isNull().cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("tokens"),
            F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        ),
        "trie",
    )

    whole = full.groupBy("conv_id").agg(F.min_by("parent_conv_id", "depth").alias("up"), (F.min("depth") - 1).alias("up_depth"), F.sum("leaves").alias("leaves"), F.sum("tokens").alias("tokens"))
    joined = path_totals(whole).where("up is not null").groupBy(F.col("up").alias("conv_id"), F.col("up_depth").alias("depth")).agg(F.sum("leaves").alias("_l"), F.sum("tokens").alias("_t"))
    own = full.join(joined, ["conv_id", "depth"], "left").withColumns({"leaves": F.col("leaves") + F.coalesce("_l", F.lit(0)), "tokens": F.col("tokens") + F.coalesce("_t", F.lit(0))}).drop("_l", "_t")
    out = along(own, ["leaves", "tokens"], piece)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("tokens").alias("saved_tokens"), "ends_sha256")
