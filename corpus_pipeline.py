"""From raw documents to packed training sequences: each stage reads what the one before it has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import jaccard, lines, substring, toxicity
from tidelog.llm.batches import saved
from tidelog.llm.catalog import labels, packed

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic. It learns from the labelled ones among `docs` outside the held-out fold."""
    return toxicity.classify(docs, labels(spark, sf_dir)).where("predicted = 0").select(COLUMNS)


def trimmed(before: DataFrame) -> DataFrame:
    """Documents whose text was cut; those that lost everything go, and n_chars follows the text."""
    left = before.where((F.size("removed") == 0) | (F.col("text") != ""))
    return left.withColumn("n_chars", F.when(F.size("removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return trimmed(lines.deduplicate(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: that with the smallest (id, number), null ids last. Rows are numbered first, so that rows stored again, rows
    without an id and different texts under one id are told apart. Texts without words have no n-grams and stay."""
    rows = saved(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_row")), "numbered")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    classes = jaccard.join(rows.select(place.alias("doc_id"), "text")).where("n_links > 0")
    others = saved(classes.where("doc_id._row <> class_id._row").select("doc_id._row"), "near")
    return rows.join(others.hint("shuffle_hash"), "_row", "left_anti").select(COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document holds, and `n_removed`, the number of spans cut from each; those that lose all words go."""
    left = substring.deduplicate(docs.select(COLUMNS)).where((F.size("removed") == 0) | F.col("text").rlike(r"\S"))
    cut = F.size("removed") > 0
    return left.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS, F.size("removed").cast("long").alias("n_removed"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("substring dedup", drop_repeated_passages),
    ("best-fit packing", pack_sequences),
]

#: Trained models, MinHash and packing have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
