"""Exact top-k search by inner product over KD-trees, one per shard.

A tree splits its shard at medians of the widest dimension; every node has a tight bounding box, so the largest product that a query can have
with any of its vectors is known. A search visits nodes in the order of that bound and stops when none can reach the kth score. Queries go
through the shards in blocks of bounded size: first each looks into its most promising leaf of every shard, and the kth score over all shards
then bounds the search proper.

Vectors that are null, or hold null or non-finite components, take no part. Vectors of different lengths are not compared; vectors of no
components have the product 0. An id names a vector: rows with a query's own id are not its candidates. Repeated rows are candidates of their
own, and repeated queries have repeated results. Only the id and the vector are read, so other columns may have any names. Products must fit
64 bits.
"""

from __future__ import annotations

import heapq
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.batches import saved

SHARD_ROWS, LEAF_ROWS, QUERY_BLOCK = 8_192, 64, 20_000


class Tree:
    """Vectors in tree order, and per node its box, its slice of vectors and its children (-1: none)."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, leaf: int = LEAF_ROWS):
        order = np.arange(len(ids))
        nodes: list[tuple] = []

        def grow(begin: int, end: int) -> int:
            here = vectors[order[begin:end]]
            low, high = here.min(axis=0), here.max(axis=0)
            at = len(nodes)
            nodes.append(None)
            left = right = -1
            width = high - low
            if end - begin > leaf and len(width) and width.max() > 0:
                axis, half = int(width.argmax()), (end - begin) // 2
                order[begin:end] = order[begin:end][np.argpartition(here[:, axis], half)]
                left, right = grow(begin, begin + half), grow(begin + half, end)
            nodes[at] = (low, high, begin, end, left, right)
            return at

        grow(0, len(order))
        low, high, begin, end, left, right = zip(*nodes, strict=True)
        self.vectors, self.ids = vectors[order], ids[order]
        self.low, self.high = np.array(low), np.array(high)
        self.begin, self.end, self.left, self.right = (list(x) for x in (begin, end, left, right))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest product of each query with any point of each node's box."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query: np.ndarray, own: int, bounds: list, k: int, kth: float, leaves: int | None = None) -> list[tuple[int, int]]:
        """The k best (score, id) of at least `kth`; with `leaves`, those of the first leaves only."""
        heap = [(-bounds[0], 0)]
        best: list[tuple] = []  # (-score, id), best first
        while heap and -heap[0][0] >= kth:
            _, node = heapq.heappop(heap)
            if self.left[node] >= 0:
                for child in (self.left[node], self.right[node]):
                    if bounds[child] >= kth:
                        heapq.heappush(heap, (-bounds[child], child))
                continue
            part = slice(self.begin[node], self.end[node])
            scores, ids = self.vectors[part] @ query, self.ids[part]
            good = (scores >= kth) & (ids != own)
            if good.any():
                scores, ids = scores[good], ids[good]
                if len(ids) > k:
                    top = np.lexsort((ids, -scores))[:k]
                    scores, ids = scores[top], ids[top]
                best = sorted(best + [(-int(s), int(i)) for s, i in zip(scores, ids, strict=True)])[:k]
                if len(best) == k:
                    kth = max(kth, -best[-1][0])
            if leaves is not None:
                leaves -= 1
                if not leaves:
                    break
        return [(-s, i) for s, i in best]


def scaled(embedding: str, scale: int) -> F.Column:
    """floor(scale * x) of each component as double, or null where the vector takes no part."""
    x = F.col(embedding)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    return F.when(x.isNotNull() & fine, F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("double")))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims)


def exact(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether products of rows of the two are exact in double precision."""
    return float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1]) < 2.0**53


def whole(a: np.ndarray) -> np.ndarray:
    """Python's integers, for products that doubles can't hold."""
    return np.array([[int(v) for v in row] for row in a], dtype=object).reshape(a.shape)


def trees(vectors: DataFrame, shards: int) -> DataFrame:
    """One row per shard and vector length: dims, tree (vectors and ids as a numpy archive, in tree order)."""

    def build(table: pa.Table) -> pa.Table:
        dims = table.column("dims")[0].as_py()
        tree = Tree(matrix(table.column("vector").combine_chunks(), dims), table.column("vec_id").to_numpy())
        out = io.BytesIO()
        np.savez(out, vectors=tree.vectors, ids=tree.ids, low=tree.low, high=tree.high, nodes=np.array([tree.begin, tree.end, tree.left, tree.right]))
        return pa.table({"dims": pa.array([dims], pa.int32()), "tree": pa.array([out.getvalue()], pa.binary())})

    keyed = vectors.withColumns({"dims": F.size("vector"), "shard": F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(shards))})
    return keyed.groupBy("dims", "shard").applyInArrow(build, "dims int, tree binary")


def load(data: bytes) -> Tree:
    tree, file = Tree.__new__(Tree), np.load(io.BytesIO(data))
    tree.vectors, tree.ids, tree.low, tree.high = (file[x] for x in ("vectors", "ids", "low", "high"))
    tree.begin, tree.end, tree.left, tree.right = (x.tolist() for x in file["nodes"])
    return tree


def search_block(forest: DataFrame, block: list, k: int, kth: dict[int, float], leaves: int | None) -> DataFrame:
    """Each shard's best candidates for a block of queries (number, id, vector)."""
    by_dims: dict[int, list] = {}
    for number, vec_id, vector in block:
        by_dims.setdefault(len(vector), []).append((number, vec_id, vector))
    packed = {
        d: (np.array([x[0] for x in rows]), np.array([x[1] for x in rows]), np.array([x[2] for x in rows], dtype=np.float64).reshape(len(rows), d), [kth.get(x[0], float("-inf")) for x in rows])
        for d, rows in by_dims.items()
    }
    shared = forest.sparkSession.sparkContext.broadcast(packed)  # at most QUERY_BLOCK vectors

    def run(batches):
        for batch in batches:
            for dims, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if dims not in shared.value:
                    continue
                tree = load(data.as_py())
                numbers, ids, queries, least = shared.value[dims]
                if not exact(tree.vectors, queries):
                    tree.vectors, tree.low, tree.high, queries = whole(tree.vectors), whole(tree.low), whole(tree.high), whole(queries)
                for at in range(0, len(ids), 256):
                    bounds = tree.bounds(queries[at : at + 256])
                    out = []
                    for i in range(at, min(at + 256, len(ids))):
                        found = tree.search(queries[i], ids[i], bounds[i - at].tolist(), k, least[i], leaves)
                        out += [(int(numbers[i]), int(ids[i]), v, s) for s, v in found]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["number", "query_id", "vec_id", "score"])

    return forest.mapInArrow(run, "number long, query_id long, vec_id long, score long")


def best(found: DataFrame, k: int) -> DataFrame:
    window = Window.partitionBy("number").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def top_k(df: DataFrame, queries: F.Column, k: int = 5, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The k best other rows for each row that fulfils `queries` (a condition on vec_id): query_id, rank, vec_id, score."""
    spark = df.sparkSession
    chosen = df.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), scaled(f"`{embedding}`", scale).alias("vector")).where("vector is not null and vec_id is not null")
    vectors = saved(chosen, "vectors")
    rows = vectors.count()
    forest = saved(trees(vectors, max(1, -(-rows // shard_rows))), "trees")
    asked = saved(vectors.where(queries).withColumn("number", F.monotonically_increasing_id()), "queries")
    blocks = max(1, -(-asked.count() // (QUERY_BLOCK // 2)))
    out = None
    for b in range(blocks):
        # Blocks by hash: half of the bound on average.
        block = [(r.number, r.vec_id, r.vector) for r in asked.where(F.pmod(F.xxhash64("number"), F.lit(blocks)) == b).collect()]
        near = best(search_block(forest, block, k, {}, 1), k).where(F.col("rank") == k)
        kth = {r.number: r.score for r in near.select("number", "score").collect()}
        found = best(search_block(forest, block, k, kth, None), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        found = saved(found, "nearest") if blocks > 1 else found
        out = found if out is None else out.unionByName(found)
    return out
