"""The window specs every operator shares.

All of them are partitioned by ``series_id``, so once a daily table has been
exchanged on that key no window, and no aggregate per series, shuffles again.
A partition holds one row per calendar day, so its size is set by the length
of the calendar (a century is 36,525 rows), never by how many transactions a
series had: those are combined before the exchange (``sources.daily``,
``operators.rows``).
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

KEY = "series_id"


def by_day(*extra: str) -> WindowSpec:
    return Window.partitionBy(KEY, *extra).orderBy("date")


def whole(*extra: str) -> WindowSpec:
    return Window.partitionBy(KEY, *extra)


def past(days: int) -> WindowSpec:
    """The previous ``days`` rows, today excluded."""
    return by_day().rowsBetween(-days, -1)


def ahead(days: int) -> WindowSpec:
    """The next ``days`` rows, today excluded."""
    return by_day().rowsBetween(1, days)


def up_to_today() -> WindowSpec:
    return by_day().rowsBetween(Window.unboundedPreceding, 0)


def day_number() -> Column:
    """0-based position of a row in its series."""
    return F.row_number().over(by_day()) - F.lit(1)
