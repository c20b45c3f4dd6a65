"""Vector functions over arrays of numbers, as column builders."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(_doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column) -> Column:
    """The vector with length one; a zero vector gives null."""
    return F.when(norm(v) > 0, F.transform(_doubles(v), lambda x: x / norm(v)))


def scaled_unit(v: Column) -> Column:
    """The unit vector times the root of its dimension."""
    return F.transform(unit(v), lambda x: x * F.sqrt(F.size(v)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null if one is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    return F.sqrt(F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def one_hot(index: Column, size: int) -> Column:
    """A vector of `size` with one at `index`."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i == index).cast("int"))


def mixed(vectors: list[Column], weights: list[float]) -> Column:
    """Weighted sum of vectors of one length."""
    total = F.transform(_doubles(vectors[0]), lambda x: x * weights[0])
    for v, w in zip(vectors[1:], weights[1:]):
        total = F.zip_with(total, F.transform(_doubles(v), _scaled(w)), lambda x, y: x + y)
    return total


def _scaled(w: float):
    return lambda x: x * w


def simplex_points(n: int, size: int, seed: int = 42) -> list[list[float]]:
    """n random mixing weights of `size` parts, uniform over all that sum to one; always the same for a seed."""
    return np.random.default_rng(seed).dirichlet(np.ones(size), n).tolist()


def end_points(size: int) -> list[list[float]]:
    """The mixing weights that take one part alone."""
    return np.eye(size).tolist()


def pooled(tokens: Column, mask: Column) -> Column:
    """The vector of the last token that the mask holds; null if it holds none."""
    return F.get(tokens, F.aggregate(mask, F.lit(0), lambda s, m: s + m.cast("int")) - 1)


def nearest(vector: Column, codes: list[tuple[int, list[float]]]) -> Column:
    """Number of the code with the least squared distance; of equal ones the smaller number. Codes are a small fixed book."""
    ranked = F.array(*[F.struct(F.round(distance(vector, F.array(*[F.lit(float(x)) for x in c])), 9).alias("d"), F.lit(k).alias("k")) for k, c in codes])
    return F.array_min(ranked)["k"]
