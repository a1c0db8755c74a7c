"""Run a day-by-day recurrence for many series at once.

A recurrence (smoothing, a stock ledger with feedback) needs its days in order,
so the unit of work is a series; what can run side by side is the series.  Spark
groups each series into arrays ordered by day and hands them to tasks in Arrow
batches; a task steps through the days once per slice of series, with one numpy
lane per series (and per setting), instead of once per series.

A series is one row per calendar day, so a row of arrays is bounded by the
length of the calendar; Arrow batches are bounded by
``spark.sql.execution.arrow.maxBytesPerBatch`` and a slice by ``MAX_VALUES``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.session import spread

MAX_VALUES = 8_000_000


def as_arrays(df: DataFrame, columns: list[str], keep: list[str] = (), key: str = "series_id") -> DataFrame:
    """One row per series: ``n`` and an array per column in day order; ``keep`` is constant per series.

    The days are spread first, so that the lanes of small arrays do not end up in one task.
    """
    day = F.struct(F.col("date").alias("date"), *[F.col(c).alias(c) for c in columns])
    grouped = spread(df, key).groupBy(key).agg(
        F.array_sort(F.collect_list(day)).alias("_days"), *[F.first(c).alias(c) for c in keep])
    return grouped.select(
        key, *keep, F.size("_days").alias("n_days"), F.col("_days.date").alias("date"),
        *[F.col(f"_days.{c}").alias(c) for c in columns])


def padded(arrays: pd.Series, width: int) -> np.ndarray:
    """Arrays of unequal length as a (width, lanes) matrix, NaN beyond the end."""
    out = np.full((width, len(arrays)), np.nan)
    for lane, values in enumerate(arrays):
        out[: len(values), lane] = np.asarray(values, dtype=float)
    return out


def run_lanes(arrays: DataFrame, step: Callable[[pd.DataFrame, int], pd.DataFrame], schema: str,
              values_per_day: int) -> DataFrame:
    """Apply ``step(rows, longest)`` to slices of series; a slice holds at most MAX_VALUES numbers
    of ``values_per_day`` numbers per series and day."""
    def slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # Similar lengths together, so padding stays small.
            batch = batch.sort_values("n_days", kind="stable")
            start = 0
            while start < len(batch):
                size = 1
                while (start + size < len(batch) and
                       (size + 1) * int(batch["n_days"].iloc[start + size]) * values_per_day <= MAX_VALUES):
                    size += 1
                rows = batch.iloc[start:start + size].reset_index(drop=True)
                result = step(rows, int(rows["n_days"].max()))
                if len(result):
                    yield result
                start += size

    return arrays.mapInPandas(slices, schema)
