"""Vector arithmetic as Column expressions, accumulated in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def l2_normalise(a: Column) -> Column:
    size = norm(a)
    return F.when(size > 0, F.transform(a, lambda x: x.cast("double") / size)).otherwise(F.transform(a, lambda x: x.cast("double")))


def mean_pool(vectors: Column, mask: Column) -> Column:
    """Mean of the token vectors whose mask is set."""
    kept = F.filter(vectors, lambda v, i: F.get(mask, i) > 0)
    total = F.aggregate(F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(0))), F.transform(kept[0], lambda x: x.cast("double")), lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.size(kept))


def vector_fault(a: Column, width: int) -> Column:
    """Why a vector can't be published: null, width, not finite, zero; null if it can."""
    odd = F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > 3.4028234663852886e38))
    return F.when(a.isNull(), "null").when(F.size(a) != width, "width").when(odd, "not finite").when(norm(a) == 0, "zero")
