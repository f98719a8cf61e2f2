"""Class-score columns and the aggregates over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.functions.lets import let


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def softmax(scores: Column) -> Column:
    shifted = let(F.array_max(scores), lambda top: F.transform(scores, lambda v: F.exp(v - top)))
    return let(shifted, lambda e: let(_total(e), lambda s: F.transform(e, lambda v: v / s)))


def log_softmax(scores: Column) -> Column:
    return let(
        F.array_max(scores),
        lambda top: let(
            F.log(_total(F.transform(scores, lambda v: F.exp(v - top)))),
            lambda log_sum: F.transform(scores, lambda v: v - top - log_sum),
        ),
    )


def argmax_class(scores: Column) -> Column:
    """Index of the largest score, the first one on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def top_k_hit(scores: Column, target: Column, k: int) -> Column:
    """Whether fewer than k scores rank before the target's; equal scores rank by index."""
    before = let(
        F.get(scores, target),
        lambda t: F.size(F.filter(scores, lambda v, i: (v > t) | ((v == t) & (i < target)))),
    )
    return F.coalesce(F.get(scores, target).isNotNull() & (before < k), F.lit(False))


def _percent(hit: Column) -> Column:
    return F.avg(hit.cast("double")) * 100.0


def accuracy(scores: Column, target: Column) -> Column:
    return _percent(argmax_class(scores) == target)


def top_k_accuracy(scores: Column, target: Column, k: int = 5) -> Column:
    return _percent(top_k_hit(scores, target, k))


def cross_entropy(scores: Column, target: Column) -> Column:
    return F.avg(-F.get(log_softmax(scores), target))
