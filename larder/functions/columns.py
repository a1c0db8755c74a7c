"""Column expressions whose null, NaN and rounding rules differ from Spark's defaults."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(c: Column, digits: int = 0) -> Column:
    """Round half to even, as pandas and numpy do (Spark's ``round`` rounds half up)."""
    return F.bround(c, digits)


def max_or_null(a: Column, b: Column) -> Column:
    """Larger of two values, NULL if either is missing (``greatest`` skips NULLs)."""
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def flag(cond: Column) -> Column:
    """A condition as 0/1, with an unknown condition counted as 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def sum_columns(cols: list[Column]) -> Column:
    """Row sum that skips missing cells; all missing gives 0."""
    zero = F.lit(0.0)
    return reduce(lambda a, b: a + b, (F.coalesce(c.cast("double"), zero) for c in cols), zero)
