"""Adapter: order lines as a daily perishable-demand table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.sources.daily import roll_up


def _quantity_if(cond: str) -> str:
    return f"sum(if({cond}, l_quantity, 0D))"


def _rows_if(cond: str) -> str:
    return f"double(count_if({cond}))"


def daily_measures() -> dict[str, Column]:
    measures = {
        "units_used": _quantity_if("l_tax < 0.065D"),
        "units_requested": "sum(l_quantity)",
        "units_received": _quantity_if("l_discount < 0.085D"),
        "units_expired": _rows_if("l_discount > 0.095D"),
    }
    measures.update({f"stock_{k}day_left": _quantity_if(f"l_linenumber = {k}") for k in range(1, 6)})
    measures.update({
        "driver_census_a": "double(sum(l_linenumber))",
        "driver_census_c": "double(count(*))",
        "driver_lab_a": _rows_if("l_discount > 0.055D"),
        "driver_lab_b": _rows_if("l_tax > 0.045D"),
        "driver_lab_c": "double(max(l_linenumber))",
    })
    return {name: F.expr(text) for name, text in measures.items()}


DAILY_COLUMNS = [
    "units_used", "units_requested", "units_received", "units_expired", *[f"stock_{k}day_left" for k in range(1, 6)],
    "driver_scheduled", "driver_census_a", "driver_census_b", "driver_census_c", "driver_lab_a", "driver_lab_b", "driver_lab_c"]


def daily(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical daily table of the order lines in ``folder``: series = return flag + line status."""
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    series = F.concat("l_returnflag", "l_linestatus")
    rolled = roll_up(lines, series, F.col("l_shipdate"), daily_measures(),
                     {"driver_scheduled": F.col("l_orderkey"), "driver_census_b": F.col("l_partkey")})
    return rolled.select("series_id", "date", *DAILY_COLUMNS)


def dirty(daily_table: DataFrame) -> DataFrame:
    """The daily table as it might arrive: text numbers, bad dates, gaps, late copies."""
    day, month = F.dayofmonth("date"), F.month("date")
    number = F.col("units_used").cast("int").cast("string")
    text_date = F.col("date").cast("string")
    first = daily_table.select(
        "series_id",
        F.when(day == 13, "bad-date").otherwise(text_date).alias("date_text"),
        F.when(day == 17, "n/a").when(day == 18, "-5")
        .when((day == 28) & (month == 2), "999999").otherwise(number).alias("units_used"),
        F.when(~((month == 3) & day.between(2, 7)), F.col("units_requested")).alias("units_requested"),
        F.when(~day.isin(9, 10), F.col("driver_census_a")).alias("driver_census_a"),
        F.lit(1).alias("ingest_seq"),
    )
    late = daily_table.filter(day == 21).select(
        "series_id",
        text_date.alias("date_text"),
        number.alias("units_used"),
        F.when(month % 2 == 0, F.col("units_requested") + 1).otherwise(F.col("units_requested"))
        .alias("units_requested"),
        "driver_census_a",
        F.lit(2).alias("ingest_seq"),
    )
    return first.unionByName(late)
