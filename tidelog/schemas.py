"""Row layouts shared by the operators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import types as T

# Fields are spelled out as types: parsing DDL text needs a running session, which importing must not.
def _row(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


# Column names of Spark's Kafka source.
LOG = _row(
    topic=T.StringType(),
    partition=T.IntegerType(),
    offset=T.LongType(),
    timestamp=T.TimestampType(),
    key=T.BinaryType(),
    value=T.BinaryType(),
)
JSON_SAMPLE = _row(x=T.ArrayType(T.DoubleType()), y=T.StringType())
# Field order is the wire order of the binary sample record.
AVRO_SAMPLE = _row(
    data=T.ArrayType(T.FloatType()),
    shape=T.ArrayType(T.IntegerType()),
    label=T.IntegerType(),
    meta=_row(dataset=T.StringType(), split=T.StringType(), index=T.IntegerType()),
)
METRICS = _row(
    phase=T.StringType(),
    epoch=T.IntegerType(),
    rank=T.IntegerType(),
    name=T.StringType(),
    value=T.DoubleType(),
)
TIMING = _row(
    experiment=T.StringType(), iteration=T.IntegerType(), rank=T.IntegerType(), seconds=T.DoubleType()
)

FORMATS = ("none", "avro", "mongodb_avro")
SPLITS = ("train", "val", "test")


@dataclass(frozen=True)
class Payload:
    """How a message body becomes a sample: format, field names and optional column transforms."""

    message_format: str = "avro"
    data_field: str = "x"
    label_field: str = "y"
    schema: T.StructType | None = None
    transform_data: Callable[[Column], Column] | None = None
    transform_label: Callable[[Column], Column] | None = None

    def __post_init__(self):
        if self.message_format not in FORMATS:
            raise ValueError(f"unsupported message format: {self.message_format}")

    @classmethod
    def default(cls) -> "Payload":
        """What a missing payload configuration means."""
        return cls(message_format="none", data_field="data", label_field="label")
