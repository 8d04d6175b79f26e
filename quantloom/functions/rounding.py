"""Rounding that two engines agree on.

The grid is shifted off the decimal halves, so a value that is an exact half of the last digit
cannot fall on either side because of the order in which a sum was taken.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHIFT = 0.5137


def settle(x: Column) -> Column:
    """Nine or more significant digits: six decimals below a thousand, three below a million, then none."""
    size = F.abs(x)
    return (
        F.when(size < 1e3, F.floor(x * 1e6 + SHIFT) / 1e6)
        .when(size < 1e6, F.floor(x * 1e3 + SHIFT) / 1e3)
        .when(size < 1e9, F.floor(x + SHIFT).cast("double"))
        .when(size < 1e15, F.floor(x / 1e3 + SHIFT) * 1e3)
        .otherwise(x)
    )


def snap(x: Column) -> Column:
    """Ten decimals below 1e5: makes ties of computed values real ties before they are ranked."""
    return F.when(F.abs(x) < 1e5, F.floor(x * 1e10 + SHIFT) / 1e10).otherwise(x)
