"""Session settings, shared scratch space and size-checked small tables."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Tables up to this many rows may travel through the driver; a larger one stays distributed.
SMALL_TABLE_ROWS = 20_000

_fallback_dirs: dict[str, str] = {}


def shuffle_partitions(executors: int, cores: int) -> int:
    return executors * cores * 2


def build_session(
    app: str = "tidelog",
    master: str | None = None,
    executors: int = 1,
    cores: int = 4,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    """Session with AQE, UTC and a shuffle width derived from the cluster size."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(shuffle_partitions(executors, cores)),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it. Only a session in one process may do without: it gets a temporary folder
    that goes when the process ends; on a cluster other machines would not see it, so there it is an error."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[[^\[\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _fallback_dirs:
        _fallback_dirs[app] = tempfile.mkdtemp(prefix="tidelog-")
        atexit.register(shutil.rmtree, _fallback_dirs[app], ignore_errors=True)
    return _fallback_dirs[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; never reused between calls."""
    return f"{shared_dir(spark)}/tidelog/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back, so that several readers share one computation and none depends on the executors that made it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_limit(spark: SparkSession) -> int:
    """Bytes up to which the session broadcasts a table."""
    return int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())


def checked_rows(df: DataFrame, limit: int = SMALL_TABLE_ROWS) -> list | None:
    """Rows of a table that is expected to be small, or None if it holds more than `limit`."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def small_table(df: DataFrame, limit: int = SMALL_TABLE_ROWS) -> tuple[DataFrame, list | None]:
    """Turn a checked-small table into a local relation, whose exact size the optimizer knows.

    Joins against it broadcast because of that size and need no hint. Beyond `limit` rows the
    table is returned as it is, so that joins shuffle and adaptive execution splits skewed keys.
    """
    rows = checked_rows(df, limit)
    if rows is None:
        return df, None
    return local_table(df.sparkSession, [row.asDict() for row in rows], df.schema), rows


def local_table(spark: SparkSession, rows: list[dict], schema) -> DataFrame:
    """Driver-side rows as a local relation with exact statistics."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    struct = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    table = pa.Table.from_pylist(rows, schema=to_arrow_schema(struct))
    return spark.createDataFrame(table, schema=struct)
