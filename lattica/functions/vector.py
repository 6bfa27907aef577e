"""Vectors as arrays of floats; no built-in vector functions are needed."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null for null or zero vectors."""
    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def distance_to(column: Column, query: Sequence[float]) -> Column:
    """Cosine distance to one known vector, whose norm is computed once."""
    norm = math.sqrt(sum(x * x for x in query))
    if not norm:
        return F.lit(None).cast("double")
    q = F.array(*(F.lit(float(x) / norm) for x in query))
    return 1 - F.try_divide(dot(column, q), F.sqrt(dot(column, column)))
