"""Vector and image feature columns, in single precision like the tensors they feed."""

from __future__ import annotations

from collections.abc import Callable
from math import prod

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.functions.lets import idiv

# Default normalization of gray digit images.
MEAN = (0.1307,)
STD = (0.3081,)


def has_shape(x: Column, shape: tuple[int, ...]) -> Column:
    return F.size(x) == prod(shape)


def require_shape(x: Column, shape: tuple[int, ...]) -> Column:
    """True, or an error that fails the job on the first vector of another size."""
    message = F.concat(F.lit(f"expected {shape}, got size "), F.size(x).cast("string"))
    return F.when(has_shape(x, shape), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))


def reshape_chw(x: Column, shape: tuple[int, int, int] = (1, 28, 28)) -> Column:
    """Flat vector to nested [channel][row][column]; another size is an error."""
    c, h, w = shape
    nested = F.transform(
        F.sequence(F.lit(0), F.lit(c - 1)),
        lambda i: F.transform(
            F.sequence(F.lit(0), F.lit(h - 1)),
            lambda j: F.slice(x, i * h * w + j * w + 1, F.lit(w)).cast("array<float>"),
        ),
    )
    return F.when(require_shape(x, shape), nested)


def conditional_reshape(x: Column, shape: tuple[int, ...] = (1, 28, 28)) -> Column:
    """Flat values with the target shape where the count matches, else with their own length as shape."""
    target = F.array(*[F.lit(n) for n in shape])
    return F.struct(
        x.cast("array<float>").alias("x"),
        F.when(has_shape(x, shape), target).otherwise(F.array(F.size(x))).alias("shape"),
    )


def scale_bytes(x: Column) -> Column:
    """8-bit values to [0, 1]."""
    return F.transform(x, lambda v: (v.cast("float") / F.lit(255.0).cast("float")).cast("float"))


def normalize(x: Column, mean: tuple[float, ...] = MEAN, std: tuple[float, ...] = STD, plane: int | None = None) -> Column:
    """(x - mean) / std; with several channels, `plane` is the number of values per channel."""
    if len(mean) == 1 and len(std) == 1:
        return F.transform(x, lambda v: _standard(v, F.lit(mean[0]), F.lit(std[0])))
    if plane is None:
        raise ValueError("plane size is needed with more than one channel")
    means = F.array(*[F.lit(m) for m in mean])
    stds = F.array(*[F.lit(s) for s in std])

    def per_channel(v: Column, i: Column) -> Column:
        channel = idiv(i, plane).cast("int")
        return _standard(v, F.get(means, channel), F.get(stds, channel))

    return F.transform(x, per_channel)


def transform_batch(images: Column, fn: Callable[[Column], Column]) -> Column:
    """Apply a vector function to every image of a batch array."""
    return F.transform(images, lambda image: fn(image))


def _standard(v: Column, mean: Column, std: Column) -> Column:
    return ((v.cast("float") - mean.cast("float")) / std.cast("float")).cast("float")
