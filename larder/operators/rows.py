"""Row repairs: dates, duplicates, calendar gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.columns import flag
from larder.functions.windows import by_day, whole

#: A gap of more days than this splits a series into spans; only the span with most days is one calendar.
MAX_GAP = 3653


def parse_dates(df: DataFrame, column: str = "date") -> DataFrame:
    """``date`` from text, timestamp or date; what cannot be read becomes NULL, time of day is cut."""
    rest = [c for c in df.columns if c not in (column, "date", "series_id")]
    return df.select("series_id", F.expr(f"try_cast(`{column}` AS date)").alias("date"), *rest)


def drop_bad_dates(df: DataFrame) -> DataFrame:
    return df.filter(F.col("date").isNotNull())


def rows_by_day(df: DataFrame, sequence: str | None = None) -> DataFrame:
    """One row per series and day of a table that may repeat days.

    Adds ``n_rows`` and ``has_conflict`` (copies that differ) and keeps the first
    copy by ``sequence``, then by content.  A day is reduced by min/max
    aggregates, which combine before the exchange, so a day repeated without
    bound never has to be sorted in one task.  Two copies differ somewhere
    exactly when the smallest and the largest copy differ.  Rows without a date
    form one group per series, which carries their count.
    """
    payload = [c for c in df.columns if c not in ("series_id", "date", sequence)]
    content = F.struct(*payload)
    order = F.struct(*([sequence] if sequence else []), content.alias("content"))
    grouped = df.groupBy("series_id", "date").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(order).alias("kept"),
        F.min(content).alias("low"),
        F.max(content).alias("high"),
    )
    return grouped.select(
        "series_id", "date", "n_rows",
        (flag(~F.col("low").eqNullSafe(F.col("high"))) * flag(F.col("date").isNotNull())).alias("has_conflict"),
        *[F.col(f"kept.content.`{c}`").alias(c) for c in payload],
    )


def row_counters(days: DataFrame) -> DataFrame:
    """Per series: dropped bad dates, conflicting dates, surplus copies, from ``rows_by_day``."""
    dated = F.col("date").isNotNull()
    return days.groupBy("series_id").agg(
        F.coalesce(F.sum(F.when(~dated, F.col("n_rows"))), F.lit(0)).cast("bigint").alias("rows_dropped_bad_date"),
        F.sum("has_conflict").cast("bigint").alias("conflicting_duplicate_dates"),
        F.coalesce(F.sum(F.when(dated, F.col("n_rows") - 1)), F.lit(0)).cast("bigint")
        .alias("duplicate_dates_removed"),
    )


def dedup_daily(df: DataFrame, sequence: str | None = None) -> DataFrame:
    """Keep the first copy of each day; rows without a date are dropped."""
    return drop_bad_dates(rows_by_day(df, sequence)).drop("n_rows", "has_conflict")


def with_span(days: DataFrame, max_gap: int = MAX_GAP) -> DataFrame:
    """Adds ``span`` (0-based; a gap of more than ``max_gap`` days starts a new one) and ``is_near`` to one row per day.

    The span of a series that has most days is the near one, the earliest if several have.  All windows are over a
    series, the partitioning the calendar needs anyway.
    """
    far = F.coalesce(F.datediff("date", F.lag("date").over(by_day())) > max_gap, F.lit(False))
    spans = days.withColumn("_far", far.cast("int")).withColumn("span", F.sum("_far").over(by_day()).cast("int"))
    size = F.struct(F.count(F.lit(1)).over(whole("span")).alias("n"), (-F.col("span")).alias("s"))
    sized = spans.withColumn("_size", size)
    return sized.withColumn("is_near", F.col("_size") == F.max("_size").over(whole())).drop("_far", "_size")


def rejected_spans(days: DataFrame, max_gap: int = MAX_GAP) -> DataFrame:
    """The side table of ``calendar_complete``: one row for each span of days too far from the rest of its series."""
    return (with_span(days, max_gap).filter(~F.col("is_near")).groupBy("series_id", "span")
            .agg(F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.count(F.lit(1)).alias("n_days")))


def calendar_complete(df: DataFrame, max_gap: int | None = MAX_GAP) -> DataFrame:
    """One row for every day between a series' first and last day, ``is_inserted`` = 1 on new ones.

    Days too far from the rest (see ``with_span``) are left out first, so that one wrong year costs one row of
    ``rejected_spans`` and not millions of inserted days; ``max_gap=None`` takes every day.

    Each row expands over the gap up to its successor, so the calendar needs no
    join and the table is exchanged once, on the key all later windows use.
    """
    if max_gap is not None:
        df = with_span(df, max_gap).filter("is_near").drop("span", "is_near")
    values = [c for c in df.columns if c not in ("series_id", "date")]
    following = F.lead("date").over(by_day())
    last_of_gap = F.coalesce(F.date_sub(F.col("_following"), 1), F.col("date"))
    spans = df.withColumn("_following", following).select(
        "series_id", F.explode(F.sequence("date", last_of_gap)).alias("_day"), "date", *values)
    observed = F.col("_day") == F.col("date")
    return spans.select(
        "series_id", F.col("_day").alias("date"),
        *[F.when(observed, F.col(c)).alias(c) for c in values],
        (~observed).cast("int").alias("is_inserted"),
    )
