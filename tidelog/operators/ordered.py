"""Order-dependent operators that never put a whole group into one task.

Both take a `bucket`: an expression that does not decrease along the order and holds a bounded number
of rows per value. Windows run inside (keys, bucket); only one summary row per bucket is chained.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions.lets import idiv
from tidelog.session import stored

# 16^4 buckets: about 15 million rows each at 10^12 rows.
HASH_DIGITS = 4
CHUNK_ROWS = 1_000_000


def _joined(left: DataFrame, right: DataFrame, cells: list[str]) -> DataFrame:
    """Inner join on columns that both have; a null joins a null."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") for c in cells], *[c for c in right.columns if c not in cells])
    same = F.lit(True)
    for c in cells:
        same = same & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return left.join(renamed, same).drop(*[f"_r_{c}" for c in cells])


def digest(*parts) -> Column:
    """Repeatable pseudo-random order key; the same text in any engine with md5."""
    return F.md5(F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def hash_bucket(digest_col: str | Column, digits: int = HASH_DIGITS) -> Column:
    return F.substring(digest_col, 1, digits)


def chunk_bucket(position: str | Column, rows: int = CHUNK_ROWS) -> Column:
    """Bucket of a dense integer position."""
    col = F.col(position) if isinstance(position, str) else position
    return idiv(col, rows)


def with_position(
    df: DataFrame, keys: list[str], order: list, bucket: Column, name: str = "pos", total: str = "n_total"
) -> DataFrame:
    """Add the dense 0-based position of each row within `keys`, and the group's row count.

    Rows are shuffled once, by (keys, bucket); the running counts hold one row per bucket. `bucket` and `order` may be expressions: they are
    evaluated on both sides of the shuffle and do not travel with the rows.
    """
    cells = [*keys, "_bucket"]
    counts = df.withColumn("_bucket", bucket).groupBy(*cells).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(
        *cells,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias(total),
    )
    inside = Window.partitionBy(*cells).orderBy(*order)
    numbered = df.repartition(*keys, bucket).withColumn("_bucket", bucket).withColumn("_in_bucket", F.row_number().over(inside))
    return (
        # Without keys the buckets are chained by one task, so they are few enough for a broadcast; the numbered rows need not move again.
        _joined(numbered, bases if keys else F.broadcast(bases), cells)
        .withColumn(name, F.col("_base") + F.col("_in_bucket") - 1)
        .drop("_bucket", "_base", "_in_bucket")
    )


def with_previous(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column, columns: list[str], name: str = "prev"
) -> DataFrame:
    """Add a struct of `columns` taken from the preceding row within `keys`, null for the first.

    The first row of a bucket gets the last row of the nearest earlier bucket, found by a
    partial aggregate of one row per bucket.
    """
    tagged = df.withColumn("_bucket", bucket)
    cells = [*keys, "_bucket"]
    picked = F.struct(*columns)
    tails = tagged.groupBy(*cells).agg(F.max_by(picked, F.struct(*order)).alias("_tail"))
    carried = tails.select(
        *cells, F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_bucket")).alias("_carry")
    )
    inside = Window.partitionBy(*cells).orderBy(*order)
    return (
        _joined(tagged.withColumn("_lag", F.lag(picked).over(inside)), carried, cells)
        .withColumn(name, F.coalesce("_lag", "_carry"))
        .drop("_bucket", "_lag", "_carry")
    )


def _preceding(keys: int, columns: int, schema: T.StructType):
    """Per task, over rows sorted by their leading `keys` columns and an order: the number of the task, whether a row is the first of its key here, and
    the `columns` that follow the keys from the row before it."""

    def run(batches):
        part, tail = TaskContext.get().partitionId(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            # The last row of the batch before stands in front, so that a shift by one row crosses batches.
            rows = pa.Table.from_batches([batch] if tail is None else [tail, batch]).combine_chunks()
            tail = batch.slice(batch.num_rows - 1)
            here, before = rows.slice(rows.num_rows - batch.num_rows), rows.slice(0, rows.num_rows - 1)
            same = pa.chunked_array([pa.array([True] * before.num_rows, pa.bool_())])
            for k in range(keys):
                a, b = before.column(k), rows.column(k).slice(1)
                nulls = pc.and_(pc.is_null(a), pc.is_null(b))
                same = pc.and_(same, pc.or_(pc.fill_null(pc.equal(a, b), False), nulls))
            missing = batch.num_rows - before.num_rows  # 1 for the first row of the task
            first = pa.chunked_array([pa.array([True] * missing, pa.bool_()), *pc.invert(same).chunks])
            shifted = [pa.chunked_array([pa.nulls(missing, before.schema.types[k]), *before.column(k).chunks]) for k in range(keys, keys + columns)]
            task = pa.chunked_array([pa.array([part] * batch.num_rows, pa.int32())])
            yield from pa.Table.from_arrays([*here.columns, *shifted, task, first], names=schema.names).combine_chunks().to_batches()

    return run


def with_previous_scan(df: DataFrame, keys: list[str], order: list[str], columns: list[str], name: str = "prev") -> DataFrame:
    """Add a struct of `columns` from the preceding row within `keys`, null for the first, by a segmented scan.

    Rows are dealt to tasks by ranges of (keys, order) with sampled bounds, so that a key with most of the rows spreads over many tasks whatever
    its order column looks like. A task looks back within its own rows; of each key it hands on its last row, and the first row of a key in a
    task takes what the nearest task before it has handed on. There is at most one such row per key and task. Rows are written once.
    """
    rest = [c for c in df.columns if c not in keys and c not in columns]
    fed = df.select(*keys, *columns, *rest).repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    before = [f"_before_{c}" for c in columns]
    schema = T.StructType([*fed.schema, *[T.StructField(b, fed.schema[c].dataType) for b, c in zip(before, columns, strict=True)], T.StructField("_part", T.IntegerType()), T.StructField("_first", T.BooleanType())])
    rows = stored(fed.mapInArrow(_preceding(len(keys), len(columns), schema), schema), "ordered")
    tails = rows.groupBy(*keys, "_part").agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_tail"))
    handed = tails.select(*keys, "_part", F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_part")).alias(name))
    heads = _joined(rows.where("_first"), handed, [*keys, "_part"])
    inner = rows.where("not _first").withColumn(name, F.struct(*[F.col(b).alias(c) for b, c in zip(before, columns, strict=True)]))
    return heads.unionByName(inner).select(*df.columns, name)
