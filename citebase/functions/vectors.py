"""Vector expressions over float arrays."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null for a null, zero or differently long vector."""
    return F.when(F.size(a) == F.size(b), 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))))


def distance_to(a: Column, query: list[float]) -> Column:
    """``cosine_distance`` to one known vector, whose own length is counted once."""
    norm = math.sqrt(sum(float(x) ** 2 for x in query))
    if not norm:
        return F.lit(None).cast("double")
    q = F.array(*(F.lit(float(x)) for x in query))
    return F.when(F.size(a) == len(query), 1 - F.try_divide(dot(a, q), F.sqrt(dot(a, a)) * F.lit(norm)))
