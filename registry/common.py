"""Inputs and output form shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larder.operators import policy, splits
from larder.operators.features import build_features
from larder.plans.cleaning import clean_daily, clean_marked
from larder.session import stored_by
from larder.sources import lineitem

DIRTY = {"date_column": "date_text", "sequence": "ingest_seq"}


def emit(df: DataFrame) -> DataFrame:
    """Dates as text and doubles to 6 places (no negative zero), so that two engines can be compared by value."""
    forms = {"date": "CAST(`{0}` AS string)", "double": "round(`{0}`, 6) + 0D", "boolean": "int(`{0}`)"}
    return df.selectExpr(*[forms.get(kind, "`{0}`").format(name) + f" AS `{name}`" for name, kind in df.dtypes])


def daily(spark: SparkSession, sf: str) -> DataFrame:
    return lineitem.daily(spark, sf)


def dirty(spark: SparkSession, sf: str) -> DataFrame:
    return lineitem.dirty(daily(spark, sf))


def clean(spark: SparkSession, sf: str) -> DataFrame:
    return clean_daily(daily(spark, sf))


def clean_dirty(spark: SparkSession, sf: str) -> DataFrame:
    return clean_daily(dirty(spark, sf), **DIRTY)


_STORED: dict[tuple[str, str, str], DataFrame] = {}


def _once(spark: SparkSession, sf: str, label: str, make) -> DataFrame:
    """A table of daily rows written to the shared folder, in buckets of series, the first time a session asks for it."""
    key = (spark.sparkContext.applicationId, sf, label)
    if key not in _STORED:
        _STORED[key] = stored_by(make(), label)
    return _STORED[key]


def clean_table(spark: SparkSession, sf: str) -> DataFrame:
    """The cleaned daily table, written once: every later job starts from it."""
    return _once(spark, sf, "clean", lambda: clean(spark, sf))


def marked_dirty(spark: SparkSession, sf: str) -> DataFrame:
    """The cleaned dirty table with its marks, written once: a report reads it several times."""
    return _once(spark, sf, "marked", lambda: clean_marked(dirty(spark, sf), **DIRTY))


def features(spark: SparkSession, sf: str) -> DataFrame:
    return build_features(clean_table(spark, sf))


def feature_table(spark: SparkSession, sf: str) -> DataFrame:
    """The feature matrix, written once; models and scores read it many times."""
    return _once(spark, sf, "features", lambda: features(spark, sf))


def window(feats: DataFrame, test_days: int = 168) -> DataFrame:
    return splits.usable(splits.backtest_window(feats, test_days))


def policy_input(spark: SparkSession, sf: str) -> DataFrame:
    """Demand, trailing-mean forecast and mean of every series."""
    return policy.fallback_forecast(clean_table(spark, sf))
