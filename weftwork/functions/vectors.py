"""Functions on arrays of numbers as vectors, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once; inside a lambda an expression would be worked out for each item."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def zero() -> Column:
    return F.lit(0.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), zero(), lambda s, x: s + x)


def added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def scaled(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x * by)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def total(a: Column) -> Column:
    return F.aggregate(a, zero(), lambda s, x: s + x)


def softmax(a: Column) -> Column:
    def shares(powers):
        return let(total(powers), lambda t: F.transform(powers, lambda x: x / t))

    return let(F.array_max(a), lambda top: let(F.transform(a, lambda x: F.exp(x - top)), shares))


def log_softmax(a: Column) -> Column:
    def logs(top):
        return let(F.ln(F.aggregate(a, zero(), lambda s, y: s + F.exp(y - top))) + top, lambda t: F.transform(a, lambda x: x - t))

    return let(F.array_max(a), logs)


def projected(matrix: list[list[float]], a: Column) -> Column:
    """A matrix of literals times a vector."""
    return F.array(*[dot(F.array(*[F.lit(float(x)) for x in row]), a) for row in matrix])


def layer_norm(a: Column, epsilon: float = 1e-5) -> Column:
    n = F.size(a)

    def normed(mean):
        spread = F.sqrt(F.aggregate(a, zero(), lambda s, x: s + (x - mean) * (x - mean)) / n + epsilon)
        return let(spread, lambda d: F.transform(a, lambda x: (x - mean) / d))

    return let(total(a) / n, normed)


def gated(state: Column, update: Column, forget: Column, accept: Column) -> Column:
    """state * sigmoid(forget) + tanh(update) * sigmoid(accept), by component."""
    kept = F.zip_with(state, forget, lambda s, f: s * sigmoid(f))
    new = F.zip_with(update, accept, lambda u, g: F.tanh(u) * sigmoid(g))
    return added(kept, new)


def mean_of(vectors: Column) -> Column:
    """By component, over an array of vectors."""
    first = F.get(vectors, F.lit(0))
    sums = F.aggregate(F.slice(vectors, F.lit(2), F.greatest(F.size(vectors) - 1, F.lit(0))), first, added)
    return let(sums, lambda v: scaled(v, 1.0 / F.size(vectors)))
