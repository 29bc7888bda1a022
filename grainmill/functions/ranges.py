"""Lookups in sorted cuts and exact rounding, as Column -> Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def range_index(x: Column, cuts: list) -> Column:
    """How many of the sorted ``cuts`` are at most ``x``, by bisection; 0 for null."""
    if not cuts:
        return F.lit(0)
    steps = [1 << k for k in range(len(cuts).bit_length() - 1, -1, -1)]
    table = F.array(*map(F.lit, cuts))

    def step(at: Column, by: Column) -> Column:
        good = (at + by <= len(cuts)) & F.coalesce(F.get(table, at + by - 1) <= x, F.lit(False))
        return F.when(good, at + by).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


def round_exact(x: Column, digits: int = 2) -> Column:
    """``x`` to ``digits`` decimals, decided on its exact binary value; true halves go to the even neighbour."""
    scale = float(10**digits)
    low = F.floor(x * scale)
    over = F.java_method(F.lit("java.lang.Math"), F.lit("fma"), x.cast("double"), F.lit(scale), -(low + F.lit(0.5))).cast("double")
    return F.when(over > 0, low + 1).when(over < 0, low).otherwise(low + F.abs(low % 2)) / F.lit(scale)
