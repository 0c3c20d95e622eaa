"""Rounding and sums that don't depend on the order of rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def even(x: Column, digits: int) -> Column:
    """Rounded half to even, with the same two products on every engine."""
    scale = F.lit(10.0**digits)
    return F.rint(x * scale) / scale


def exact(x: Column) -> Column:
    """A confidence as a decimal of ten places, whose sums are exact."""
    return x.cast("decimal(14,10)")


def mean_of(x: Column) -> Column:
    return F.sum(exact(x)).cast("double") / F.count(x)


def deviation_of(x: Column, sample: bool = False) -> Column:
    """Standard deviation (of the population, or of a sample) from exact sums of values and squares."""
    n = F.count(x).cast("double")
    total, squares = F.sum(exact(x)).cast("double"), F.sum(exact(x) * exact(x)).cast("double")
    spread = F.greatest(squares - total * total / n, F.lit(0.0))
    if sample:
        return F.when(n > 1, F.sqrt(spread / F.greatest(n - 1, F.lit(1.0)))).when(n == 1, 0.0)
    return F.sqrt(spread / n)
