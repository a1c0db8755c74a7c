"""Build canonical daily tables from transactions or from any daily table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder import schema


def roll_up(transactions: DataFrame, series_id: Column, date: Column, measures: dict[str, Column],
            distinct: dict[str, Column] | None = None) -> DataFrame:
    """One row per series and day, ``measures`` first, then the ``distinct`` counts (double, NULL values not counted).

    The aggregates combine before the exchange, so a series or day that holds
    most of the transactions sends one partial row per map task.  Each distinct count is a
    branch of its own that reads three columns and is grouped by (series, day, value) first, which spreads
    a hot day over tasks; counts and measures meet as rows of one key, so no wide row is copied for each count.
    """
    keys = ["series_id", "date"]
    keyed = transactions.withColumns({"series_id": series_id, "date": date.cast("date")})
    rolled = keyed.groupBy(*keys).agg(*[c.alias(name) for name, c in measures.items()])
    if not distinct:
        return rolled
    parts = [rolled]
    for name, value in distinct.items():
        seen = keyed.select(*keys, value.alias("_value")).filter(F.col("_value").isNotNull()).distinct()
        parts.append(seen.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias(name)))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.groupBy(*keys).agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in measures],
        *[F.coalesce(F.first(c, ignorenulls=True), F.lit(0.0)).alias(c) for c in distinct])


def conform(df: DataFrame, shelf_life: int = 5, keep_extra: bool = False) -> DataFrame:
    """Project any daily table on the canonical columns of a shelf life; absent columns are NULL."""
    wanted = schema.schema_columns(shelf_life)
    present = set(df.columns)
    cols = [F.col("series_id").cast("string").alias("series_id")]
    for name in wanted:
        kind = schema.column_type(name)
        value = F.col(name) if name in present else F.lit(None)
        cols.append(value.cast(kind).alias(name))
    if keep_extra:
        cols += [F.col(c) for c in df.columns if c != "series_id" and c not in wanted]
    return df.select(*cols)


def short_history(events: DataFrame) -> DataFrame:
    """Daily counts of an event log: series = event type, used = count, requested = high values."""
    return roll_up(
        events, F.col("event_type"), F.col("ts"),
        {"units_used": F.count(F.lit(1)).cast("double"),
         "units_requested": F.count_if(F.col("value") > 50).cast("double")},
    )
