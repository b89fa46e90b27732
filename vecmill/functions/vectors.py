"""Vector expressions on array columns, evaluated in the JVM and in double precision.

A vector whose norm is zero, NaN or infinite counts as the zero vector: its similarity to anything is 0. Null vectors, vectors with
null elements and vectors of unequal length give null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products; null unless both have the same number of elements."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total)


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def proper(n: Column) -> Column:
    """Whether a norm is positive and finite. NaN is greater than any number here."""
    return (n > 0) & (n < F.lit(float("inf")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 where either vector counts as zero."""
    na, nb = norm(a), norm(b)
    product = dot(a, b)
    return F.when(product.isNull(), F.lit(None).cast("double")).when(proper(na) & proper(nb), product / (na * nb)).otherwise(F.lit(0.0))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine(a, b)


def similarity(a: Column, b: Column, metric: str = "cosine") -> Column:
    """The similarity of a metric: cosine or dot_product."""
    if metric not in ("cosine", "dot_product"):
        raise ValueError(f"unknown metric {metric}")
    return cosine(a, b) if metric == "cosine" else dot(a, b)


def normalize(a: Column) -> Column:
    """A vector of length 1 in the same direction; all zeros where it counts as zero."""
    n = norm(a)
    return F.when(proper(n), F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: F.lit(0.0)))


def usable(a: Column, dim: int) -> Column:
    """Whether a vector can be stored in a column of that dimension: never null."""
    return F.coalesce((F.size(a) == dim) & ~F.exists(a, lambda x: x.isNull()), F.lit(False))
