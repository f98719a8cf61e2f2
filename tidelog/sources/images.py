"""Image files to gray vectors: JVM decode, then one vectorized luma pass per Arrow batch."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ITU-R 601 luma weights for red, green, blue in 16-bit fixed point.
LUMA = (19595, 38470, 7471)
LUMA_HALF = 0x8000


def gray_bytes(data: bytes, channels: int) -> np.ndarray:
    """Luma of BGR, BGRA or gray bytes, as 0..255."""
    pixels = np.frombuffer(data, dtype=np.uint8)
    if channels == 1:
        return pixels
    bgr = pixels.reshape(-1, channels).astype(np.int64)
    red, green, blue = LUMA
    return ((bgr[:, 2] * red + bgr[:, 1] * green + bgr[:, 0] * blue + LUMA_HALF) >> 16).astype(np.uint8)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def gray_pixels(data: pd.Series, channels: pd.Series) -> pd.Series:
    return pd.Series([gray_bytes(d, c).astype(np.int32) if c > 0 else None for d, c in zip(data, channels)])


def gray_unit(data: Column, channels: Column) -> Column:
    """Image bytes to a gray float vector in [0, 1]."""
    return F.transform(gray_pixels(data, channels), lambda v: (v / F.lit(255.0)).cast("float"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Rows of origin, shape [1, height, width], `x` and `is_bad`; a file that is no image has neither shape nor `x`."""
    image = spark.read.format("image").option("dropInvalid", False).load(path)
    bad = F.col("image.nChannels") < 1
    return image.select(
        F.col("image.origin").alias("origin"),
        F.when(~bad, F.array(F.lit(1), "image.height", "image.width")).alias("shape"),
        gray_unit(F.col("image.data"), F.col("image.nChannels")).alias("x"),
        bad.alias("is_bad"),
    )
