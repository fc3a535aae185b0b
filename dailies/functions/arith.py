"""Integer arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def idiv(a: Column | str, b: int | Column) -> Column:
    """Integral quotient of non-negative numbers (no detour through doubles)."""
    return F.call_function("div", F.col(a) if isinstance(a, str) else a, b if isinstance(b, Column) else F.lit(b))


def floor_div(a: Column | str, b: int) -> Column:
    """Integral quotient rounded down, also for negative numbers."""
    a = F.col(a) if isinstance(a, str) else a
    return idiv(a - F.pmod(a, F.lit(b)), b)


def round_div(a: Column | str, b: int) -> Column:
    """Quotient of a non-negative number rounded half up."""
    a = F.col(a) if isinstance(a, str) else a
    return idiv(a * 2 + b, 2 * b)
