"""Array-valued helpers built from higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = 0.0


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(ZERO), lambda acc, x: acc + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def scale(v: Column, factor: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double") * factor)


def cosine(a: Column, b: Column, eps: float = 1e-12) -> Column:
    return dot(a, b) / ((norm(a) + eps) * (norm(b) + eps))


def argmax(v: Column) -> Column:
    """Zero-based position of the first maximum."""
    return F.array_position(v, F.array_max(v)) - 1


def sharpen(p: Column, temperature: float) -> Column:
    """p^(1/T) normalised: the softmax of logits/T when p is the softmax of logits."""
    raised = F.transform(p, lambda x: F.pow(x, F.lit(1.0 / temperature)))
    return F.transform(raised, lambda x: x / total(raised))


def weighted_mean(vectors: list[Column], weights: list[float]) -> Column:
    """Element-wise weighted mean of equally long arrays."""
    whole = float(sum(weights))

    def plus(a: Column, b: Column, share: float) -> Column:
        return F.zip_with(a, b, lambda x, y: x + y.cast("double") * share)

    acc = scale(vectors[0], F.lit(weights[0] / whole))
    for v, w in zip(vectors[1:], weights[1:]):
        acc = plus(acc, v, w / whole)
    return acc
