"""Small building blocks for column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and use it in `body`, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ratio(a: Column, b: Column) -> Column:
    """Division of doubles that never fails: a zero divisor gives infinity, or not-a-number for 0/0."""
    zero = F.when(a == 0, F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf")))
    return F.when(b == 0, zero).otherwise(F.try_divide(a.cast("double"), b.cast("double")))


def idiv(a: Column | str, b: Column | int) -> Column:
    """Whole-number division; exact for positions beyond the range of doubles."""
    left = F.col(a) if isinstance(a, str) else a
    return F.call_function("div", left, b if isinstance(b, Column) else F.lit(b))
