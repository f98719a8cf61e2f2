"""Message bodies to samples: JSON, binary records, and binary records wrapped in JSON."""

from __future__ import annotations

import json
import secrets

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.schemas import JSON_SAMPLE, Payload
from tidelog.session import stored
from tidelog.sources.avro import decode_samples

CORRUPT = "_corrupt"


def _apply(fn, col: Column) -> Column:
    return fn(col) if fn else col


def decode_json(df: DataFrame, payload: Payload, value: str = "value") -> DataFrame:
    """Add `x`, `y` and `is_bad`; a missing field is null, an unreadable body is bad."""
    fields = payload.schema or T.StructType(
        [
            T.StructField(payload.data_field, JSON_SAMPLE["x"].dataType),
            T.StructField(payload.label_field, JSON_SAMPLE["y"].dataType),
        ]
    )
    # The body is parsed once, as the middle of three elements: a bare parse would stop at the end of the first object and accept
    # whatever follows it. The outer elements hold a mark drawn when the query is built. Text that closes the array and opens another one
    # cannot put the mark at its start, so exactly three elements with the mark at both ends mean one whole body.
    seal = "_end" if "_end" not in fields.names else "_".join(fields.names) + "_end"
    mark = secrets.token_hex(16)
    wrapped = T.StructType([T.StructField("parts", T.ArrayType(T.StructType([*fields, T.StructField(seal, T.StringType())]))), T.StructField(CORRUPT, T.StringType())])
    end = json.dumps({seal: mark})
    text = F.concat(F.lit(f'{{"parts":[{end},'), F.col(value).cast("string"), F.lit(f",{end}]}}"))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "allowSingleQuotes": "false"}
    parts = F.col("_parsed.parts")
    body = F.get(parts, F.lit(1))
    whole = F.col(f"_parsed.{CORRUPT}").isNull() & (F.size(parts) == 3) & body.isNotNull()
    whole = whole & (F.get(parts, F.lit(0))[seal] == mark) & (F.get(parts, F.lit(2))[seal] == mark)
    # Parsing goes through a generator: a filter on its result would otherwise move below it and parse every body again.
    return (
        df.withColumn("_parsed", F.explode(F.array(F.from_json(text, wrapped, options))))
        .withColumn("is_bad", ~F.coalesce(whole, F.lit(False)))
        .withColumn("_body", F.when(~F.col("is_bad"), body))
        .withColumn("x", _apply(payload.transform_data, F.col(f"_body.{payload.data_field}")))
        .withColumn("y", _apply(payload.transform_label, F.col(f"_body.{payload.label_field}")))
        .drop("_parsed", "_body", value)
    )


def unwrap_base64(df: DataFrame, path: str = "$.binary_data.Data", value: str = "value") -> DataFrame:
    """Take the base64 text at `path` of a JSON body and put its bytes in place of the body."""
    return df.withColumn(value, F.unbase64(F.get_json_object(F.col(value).cast("string"), path)))


def decode_avro(df: DataFrame, payload: Payload, value: str = "value") -> DataFrame:
    """Add `x`, `y` and `is_bad` from binary sample records."""
    return (
        decode_samples(df, value)
        .withColumn("x", _apply(payload.transform_data, F.col(f"sample.{payload.data_field}")))
        .withColumn("y", _apply(payload.transform_label, F.col(f"sample.{payload.label_field}")))
        .withColumn("is_bad", F.col("sample").isNull())
        .drop("sample")
    )


def decode(df: DataFrame, payload: Payload | None = None, value: str = "value") -> DataFrame:
    """The payload's message format picks the decoder."""
    payload = payload or Payload.default()
    if payload.message_format == "none":
        return decode_json(df, payload, value)
    if payload.message_format == "avro":
        return decode_avro(df, payload, value)
    return decode_avro(unwrap_base64(df, value=value), payload, value)


def dead_letter(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows and bad rows, so that nothing is lost to a bad message."""
    return decoded.where(~F.col("is_bad")).drop("is_bad"), decoded.where("is_bad").drop("is_bad", "x", "y")


def strict_prefix(decoded: DataFrame, keys: tuple[str, ...] = ("split_idx", "partition")) -> DataFrame:
    """Per range, keep only what precedes its first bad message.

    Rows are decoded once and written; the bad offsets and the rows before them are read from there. First-bad offsets are a partial aggregate
    with at most one row per range.
    """
    rows = stored(decoded, "decoded")
    first_bad = rows.where("is_bad").groupBy(*keys).agg(F.min("offset").alias("_first_bad"))
    return (
        rows.join(first_bad, list(keys), "left")
        .where(F.col("_first_bad").isNull() | (F.col("offset") < F.col("_first_bad")))
        .drop("_first_bad", "is_bad")
    )
