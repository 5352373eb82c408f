"""Column expressions shared by the operators.

Load is held as a fixed-point integer of milli-kW (``*_milli`` columns, long)
from the moment it is read until the last step.  Integer sums are exact, so a
total does not depend on partitioning, task order or engine, and a mean is
``(sum / 1000.0) / count`` evaluated once.  Conversion back to kW is a single
IEEE division, identical in every engine.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: load resolution of the integer representation (1 unit = 0.001 kW).
MILLI = 1000


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def to_milli(kw: str | Column) -> Column:
    """kW (double) -> milli-kW (long), rounded to the nearest unit."""
    return F.round(_c(kw) * MILLI).cast("long")


def from_milli(milli: str | Column) -> Column:
    """milli-kW (long) -> kW (double)."""
    return _c(milli) / F.lit(float(MILLI))


def mean_from_milli(sum_milli: str | Column, count: str | Column) -> Column:
    """Mean in kW from an exact integer sum and a count; null when count is 0
    (the division is guarded, so ANSI mode never raises)."""
    return F.when(_c(count) > 0, from_milli(sum_milli) / _c(count))


def count_non_null(cols: list[str | Column]) -> Column:
    """How many of the columns hold a value."""
    return reduce(add, [_c(c).isNotNull().cast("int") for c in cols])


def null_safe_mean(cols: list[str | Column]) -> Column:
    """Mean of the non-null columns, 0.0 when all are null.

    Left fold ``((0.0 + c1) + c2) + ...`` over ``coalesce(c, 0.0)`` divided by
    ``greatest(count_non_null, 1)``: the array-and-fold form, written as plain
    arithmetic so it stays inside generated code.
    """
    total = reduce(add, [F.coalesce(_c(c), F.lit(0.0)) for c in cols], F.lit(0.0))
    return total / F.greatest(count_non_null(cols), F.lit(1))


def row_sum_null_as_zero(cols: list[str | Column]) -> Column:
    """Row-wise sum, null read as 0.0 (combining per-series forecast columns)."""
    return reduce(add, [F.coalesce(_c(c), F.lit(0.0)) for c in cols])


def clip(col: str | Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(_c(col), F.lit(lo)), F.lit(hi))
