"""How many candidates to fetch for k results: max(k, trunc(a + b k + c k ln k)), and 0 for k below 1."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients for token hits of each query token, and for documents to score.
TOKENS = (94.9, 11.0, -1.48)
CANDIDATES = (8.82, 1.13, -0.00471)


def expand_parameter(k: int, a: float, b: float, c: float) -> int:
    return 0 if k < 1 else max(k, int(a + b * k + c * k * math.log(k)))


def expanded(k: Column, a: float, b: float, c: float) -> Column:
    """The same of a column; null stays null."""
    value = (F.lit(a) + F.lit(b) * k + F.lit(c) * k * F.ln(F.greatest(k, F.lit(1)))).cast("int")
    return F.when(k.isNull(), F.lit(None).cast("int")).when(k < 1, F.lit(0)).otherwise(F.greatest(k.cast("int"), value))
