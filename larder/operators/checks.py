"""Checks and derived demand on a repaired daily table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.columns import flag, half_even, max_or_null, sum_columns
from larder.functions.windows import by_day, past, whole
from larder.schema import stock_columns_in


def inventory_reconcile(df: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Flag days whose change in total stock is not received - used - expired."""
    stock = stock_columns_in(df.columns)
    if not stock or not {"units_received", "units_used", "units_expired"} <= set(df.columns):
        return df
    with_total = df.withColumn("_total", sum_columns([F.col(c) for c in stock]))
    change = F.col("_total") - F.lag("_total").over(by_day())
    flow = F.col("units_received") - F.col("units_used") - F.col("units_expired")
    return (with_total.withColumn("_change", change)
            .withColumn("inventory_mismatch", flag(F.abs(F.col("_change") - flow) > tolerance))
            .drop("_total", "_change"))


def decensor_demand(df: DataFrame) -> DataFrame:
    """``demand_model``: requested on a shortage day, used otherwise; a lower bound on true need."""
    used = F.col("units_used").cast("double") if "units_used" in df.columns else F.lit(None).cast("double")
    if "units_requested" not in df.columns or "units_used" not in df.columns:
        return df.withColumn("demand_model", used)
    requested = F.col("units_requested")
    return df.withColumns({
        "is_shortage": flag(requested > used),
        "demand_model": max_or_null(used, requested),
    })


def usage_avg_7d(df: DataFrame, column: str = "demand_model") -> DataFrame:
    """Mean of the previous 7 days, today excluded, one decimal."""
    return df.withColumn("usage_avg_7d", half_even(F.avg(column).over(past(7)), 1))


def demand_outlier_mad(df: DataFrame, k: float = 4.0) -> DataFrame:
    """Flag surge days: robust z of the distance from the series' own weekday level."""
    level = F.median("demand_model").over(whole("_weekday"))
    return (
        df.withColumn("_weekday", F.weekday("date"))
        .withColumn("_resid", F.col("demand_model") - level)
        .withColumn("_centred", F.col("_resid") - F.median("_resid").over(whole()))
        .withColumn("_mad", F.median(F.abs("_centred")).over(whole()))
        .withColumn("_z", F.lit(0.6745) * F.col("_centred")
                    / F.when(F.col("_mad") == 0, F.lit(1.0)).otherwise(F.col("_mad")))
        .withColumn("is_demand_outlier", flag(F.abs("_z") > k))
        .drop("_weekday", "_resid", "_centred", "_mad", "_z")
    )
