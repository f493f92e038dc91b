"""Vector similarity as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine_to(a: Column, query: list[float]) -> Column:
    """Cosine similarity to a literal vector. Null and zero vectors have none."""
    q = F.array(*[F.lit(float(x)) for x in query])
    length = sum(x * x for x in query) ** 0.5
    a = a.cast("array<double>")
    return dot(a, q) / F.nullif(norm(a) * F.lit(length), F.lit(0.0))


def zero_padded(a: Column, size: int) -> Column:
    return F.concat(a, F.array_repeat(F.lit(0.0), F.greatest(F.lit(size) - F.size(a), F.lit(0))))
