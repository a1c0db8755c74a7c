"""Forecasts that need no fit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.windows import by_day, past

LONG = ["series_id", "date", "model", "forecast", "actual"]


def lag_forecast(days: int) -> Column:
    return F.lag("y", days).over(by_day())


def mean_forecast(days: int) -> Column:
    return F.avg("y").over(past(days))


def long_forecasts(df: DataFrame, models: dict[str, Column]) -> DataFrame:
    """One row per model and day from forecast columns of one pass; ``df`` carries ``y``."""
    wide = df.select("series_id", "date", "t", F.col("y").alias("actual"),
                     *[c.alias(f"_fc_{name}") for name, c in models.items()])
    cells = F.inline(F.array(*[
        F.struct(F.lit(name).alias("model"), F.col(f"_fc_{name}").cast("double").alias("forecast"))
        for name in models]))
    return wide.select("series_id", "date", "t", "actual", cells).select(*LONG, "t")


def seasonal_naive(features: DataFrame, split: DataFrame, season: int = 7) -> DataFrame:
    """The same weekday last week, over the test block of every series."""
    lagged = long_forecasts(features.select("series_id", "date", "t", "y"),
                            {"seasonal_naive": lag_forecast(season)})
    return in_test_block(lagged, split).select(*LONG)


def in_test_block(forecasts: DataFrame, split: DataFrame) -> DataFrame:
    """Forecasts of the test days; ``forecasts`` carries ``t``."""
    return (forecasts.join(split, "series_id")
            .filter((F.col("t") >= F.col("t0")) & (F.col("t") < F.col("n"))))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
