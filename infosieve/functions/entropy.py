"""Information-theoretic building blocks as JVM-side Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def xlog2x(c: Column) -> Column:
    """h(x) = x * log2(x) with h(0) = 0; counts are cast to double before any product."""
    x = c.cast("double")
    return F.when(x > 0, x * F.log2(x)).otherwise(F.lit(0.0))
