"""Arrow batches of bounded size, and tables written to the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.session import scratch_path

SLICE_BYTES = 4_000_000


#: Spark then drops a query's shuffle files when the query is over, not when the driver's memory is next cleaned.
FREES_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: later steps neither recompute it nor depend on the executors that made it. Its shuffle files go
    when it is written."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    before = spark.conf.get(FREES_SHUFFLES, None)
    spark.conf.set(FREES_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREES_SHUFFLES, before) if before is not None else spark.conf.unset(FREES_SHUFFLES)
    return spark.read.schema(df.schema).parquet(path)


def unused(name: str, columns: list[str]) -> str:
    """A name that none of the columns has."""
    while name in columns:
        name += "_"
    return name


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most `limit` bytes in `column`; a larger single value is a part of its own."""
    values = batch.column(column)
    if values.nbytes <= limit:
        if batch.num_rows:
            yield batch
        return
    if batch.num_rows == 1:
        yield batch
        return
    half = batch.num_rows // 2
    yield from slices(batch.slice(0, half), column, limit)
    yield from slices(batch.slice(half), column, limit)


def with_column(
    df: DataFrame, source: str, name: str, kind: T.DataType, setup: Callable[[], Callable[[pa.Array], pa.Array]]
) -> DataFrame:
    """Add or replace column `name`, made from column `source` in Arrow slices. `setup` runs once per task."""
    kept = [c for c in df.columns if c != name]
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField(name, kind)])
    at = kept.index(source) if source in kept else None

    def run(batches):
        make = None
        for batch in batches:
            for part in slices(batch, len(kept)):
                make = make or setup()
                columns = [part.column(i) for i in range(len(kept))]
                made = make(part.column(len(kept)) if at is None else columns[at])
                yield pa.RecordBatch.from_arrays([*columns, made], names=[*kept, name])

    # The source travels once more as last column, so that it can also be the replaced one.
    fed = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{source}`").alias(unused("_source", kept)))
    return fed.mapInArrow(run, schema)
