"""Continuous log ingest: poll, decode, assign split and rank, and keep bad messages apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.schemas import Payload
from tidelog.sources.decode import decode
from tidelog.sources.log import read_ranges


def stream_parquet(spark: SparkSession, path: str, schema, pattern: str | None = None, files_per_trigger: int = 1000) -> DataFrame:
    """Parquet files as they arrive, from the earliest on."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(path)


def stream_kafka(spark: SparkSession, servers: list[str], topic: str, per_trigger: int = 10_000_000) -> DataFrame:
    """Topic from the earliest offset. Needs the Kafka connector on the class path; untested without it."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", ",".join(servers))
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .option("maxOffsetsPerTrigger", per_trigger)
        .load()
    )


def ingest(
    log: DataFrame, plan: DataFrame, payload: Payload, samples_path: str, dead_path: str, checkpoint: str
) -> StreamingQuery:
    """Decode a streamed log against a split plan into a sample table and a dead-letter table.

    Each micro-batch is written under its own number, so a batch that is replayed after a failure replaces itself.
    """
    decoded = decode(read_ranges(log, plan), payload).withColumn("rank", F.col("partition"))

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            good = kept.where(~F.col("is_bad")).drop("is_bad")
            bad = kept.where("is_bad").select("split_idx", "topic", "partition", "offset")
            good.write.mode("overwrite").parquet(f"{samples_path}/batch={batch_id}")
            bad.write.mode("overwrite").parquet(f"{dead_path}/batch={batch_id}")
        finally:
            kept.unpersist()

    return (
        decoded.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
