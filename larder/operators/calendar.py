"""Calendar columns and US federal holidays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values: (month, day) of the holidays that move off a weekend.
FIXED_HOLIDAYS = [(1, 1), (6, 19), (7, 4), (11, 11), (12, 25)]
# Fixed values: (month, weekday with Monday 0, first and last day of month it can fall on).
FLOATING_HOLIDAYS = [
    (1, 0, 15, 21),   # third Monday of January, from 1986
    (2, 0, 15, 21),   # third Monday of February
    (5, 0, 25, 31),   # last Monday of May
    (9, 0, 1, 7),     # first Monday of September
    (10, 0, 8, 14),   # second Monday of October
    (11, 3, 22, 28),  # fourth Thursday of November
]
JANUARY_MONDAY_FROM = "1986-01-01"
JUNE_19_FROM = "2021-06-18"

MONDAY, FRIDAY = 0, 4


def _fixed_day(d: str) -> str:
    """Whether a date is one of the fixed-day holidays before any move off a weekend."""
    days = ", ".join(str(100 * m + day) for m, day in FIXED_HOLIDAYS)
    return f"(100 * month({d}) + day({d}) IN ({days}))"


def federal_holiday_sql(d: str = "date") -> str:
    """Holiday test on a date column alone: no dimension table, no join, no known year range.

    A fixed-day holiday on Saturday is observed the Friday before, on Sunday the
    Monday after, so 31 December can be a holiday of the next year.
    """
    observed = (f"(weekday({d}) <= {FRIDAY} AND {_fixed_day(d)}"
                f" OR weekday({d}) = {FRIDAY} AND {_fixed_day(f'date_add({d}, 1)')}"
                f" OR weekday({d}) = {MONDAY} AND {_fixed_day(f'date_sub({d}, 1)')})"
                f" AND NOT (month({d}) = 6 AND {d} < DATE'{JUNE_19_FROM}')")
    floating = [f"month({d}) = {m} AND weekday({d}) = {wd} AND day({d}) BETWEEN {lo} AND {hi}"
                + (f" AND {d} >= DATE'{JANUARY_MONDAY_FROM}'" if m == 1 else "")
                for m, wd, lo, hi in FLOATING_HOLIDAYS]
    return " OR ".join(f"({rule})" for rule in [observed, *floating])


def holiday_table(spark: SparkSession, first: str, last: str) -> DataFrame:
    """The holidays between two dates."""
    days = spark.range(1).select(
        F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("date"))
    return days.filter(federal_holiday_sql("date"))


def calendar_columns(df: DataFrame) -> DataFrame:
    """Recompute day name, weekend and holiday flags from the date."""
    return df.withColumns({
        "day_of_week": F.date_format("date", "EEEE"),
        "is_weekend": F.expr("if(weekday(date) >= 5, 1, 0)"),
        "is_holiday": F.expr(f"if({federal_holiday_sql('date')}, 1, 0)"),
    })
