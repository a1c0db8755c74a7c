"""Queries over sources, cleaning and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.windows import whole
from larder.operators import calendar, checks, diagnostics, rows, splits, values
from larder.operators import features as feat
from larder.plans import cleaning
from larder.session import new_path
from larder.sources import daily as sources
from larder.sources.sink import write_report
from registry.common import (clean, clean_dirty, clean_table, daily, dirty, emit, feature_table, features,
                             marked_dirty, window)

DIRTY_NUMBERS = ["units_used", "units_requested", "driver_census_a"]


def daily_source(spark: SparkSession, sf: str) -> DataFrame:
    return emit(daily(spark, sf))


def schema_conform(spark, sf):
    return emit(sources.conform(daily(spark, sf), shelf_life=7))


def short_history(spark, sf):
    return emit(sources.short_history(spark.read.parquet(f"{sf}/events.parquet")))


def report_sink(spark, sf):
    profile = diagnostics.realism_profile(clean_table(spark, sf))
    return emit(write_report(profile, new_path(spark, "report")))


def _dated(spark, sf):
    return rows.parse_dates(dirty(spark, sf), "date_text")


def drop_bad_dates(spark, sf):
    dated = _dated(spark, sf)
    return emit(dated.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("rows_in"), F.count_if(F.col("date").isNull()).alias("rows_dropped_bad_date")))


def conflicting_dates(spark, sf):
    days = rows.drop_bad_dates(rows.rows_by_day(_dated(spark, sf), "ingest_seq"))
    return emit(days.filter(F.col("has_conflict") == 1).select("series_id", "date", "n_rows"))


def dup_removed(spark, sf):
    return emit(rows.row_counters(rows.rows_by_day(_dated(spark, sf), "ingest_seq")))


def dedup_daily(spark, sf):
    return emit(rows.dedup_daily(_dated(spark, sf), "ingest_seq"))


def _complete(spark, sf):
    return rows.calendar_complete(rows.dedup_daily(_dated(spark, sf), "ingest_seq"))


def calendar_complete(spark, sf):
    return emit(_complete(spark, sf))


def _far(spark, sf):
    """The dirty table with two stray days for each series: its first row again in the year 1066 and in the year 9999."""
    days = rows.dedup_daily(_dated(spark, sf), "ingest_seq")
    first = F.min("date").over(whole())
    strays = F.array(F.lit("1066-10-14").cast("date"), F.lit("9999-12-31").cast("date"))
    again = days.withColumn("_first", first).filter(F.col("date") == F.col("_first")).drop("_first")
    return days.unionByName(again.withColumn("date", F.explode(strays)))


def calendar_rejects(spark, sf):
    return emit(rows.rejected_spans(_far(spark, sf)))


def calendar_complete_far(spark, sf):
    return emit(rows.calendar_complete(_far(spark, sf)))


def _numeric(spark, sf):
    return values.coerce_numeric(_complete(spark, sf), DIRTY_NUMBERS)


def coerce_numeric(spark, sf):
    return emit(_numeric(spark, sf).select("series_id", "date", *DIRTY_NUMBERS))


def _positive(spark, sf):
    return values.negatives_to_null(_numeric(spark, sf), DIRTY_NUMBERS)


def negatives_to_null(spark, sf):
    return emit(_positive(spark, sf).select("series_id", "date", *DIRTY_NUMBERS, "negative_cells"))


def null_run_length(spark, sf):
    df = _positive(spark, sf)
    for c in DIRTY_NUMBERS:
        df = values.null_run_length(df, c, f"run_{c}")
    return emit(df.select("series_id", "date", *[f"run_{c}" for c in DIRTY_NUMBERS]))


def ffill_short(spark, sf):
    filled = values.fill_short_gaps(_positive(spark, sf), DIRTY_NUMBERS[:2], [])
    return emit(filled.select("series_id", "date", *DIRTY_NUMBERS[:2]))


def interpolate_short(spark, sf):
    filled = values.fill_short_gaps(_positive(spark, sf), [], ["driver_census_a"])
    return emit(filled.select("series_id", "date", "driver_census_a"))


def fill_past_only(spark, sf):
    filled = values.fill_short_gaps(_positive(spark, sf), [], ["driver_census_a"], past_only=True)
    return emit(filled.select("series_id", "date", "driver_census_a"))


def imputed_flag(spark, sf):
    return emit(clean_dirty(spark, sf).select("series_id", "date", "row_was_imputed"))


def long_gap_cells(spark, sf):
    return emit(marked_dirty(spark, sf).groupBy("series_id").agg(
        F.sum("missing_cells").cast("bigint").alias("cells_left_missing_long_gap")))


def high_outlier_flag(spark, sf):
    flagged = values.high_outlier_flag(_positive(spark, sf), DIRTY_NUMBERS)
    return emit(flagged.select("series_id", "date", "has_high_outlier",
                               F.concat_ws(",", "high_outlier_columns").alias("high_outlier_columns")))


def calendar_cols(spark, sf):
    cols = calendar.calendar_columns(_complete(spark, sf))
    return emit(cols.select("series_id", "date", "day_of_week", "is_weekend"))


def federal_holidays(spark, sf):
    cols = calendar.calendar_columns(_complete(spark, sf))
    return emit(cols.select("series_id", "date", "is_holiday"))


def inventory_reconcile(spark, sf):
    return emit(clean(spark, sf).select("series_id", "date", "inventory_mismatch"))


def decensor_demand(spark, sf):
    return emit(checks.decensor_demand(_positive(spark, sf)).select(
        "series_id", "date", "is_shortage", "demand_model"))


def demand_outlier_mad(spark, sf):
    return emit(clean_dirty(spark, sf).select("series_id", "date", "demand_model", "is_demand_outlier"))


def usage_avg_7d(spark, sf):
    return emit(clean_dirty(spark, sf).select("series_id", "date", "usage_avg_7d"))


def cleaning_report(spark, sf):
    report = cleaning.cleaning_report(marked_dirty(spark, sf))
    return emit(report.withColumn("high_value_outlier_columns", F.concat_ws(",", "high_value_outlier_columns")))


def df_stationarity(spark, sf):
    return emit(diagnostics.stationarity(clean_table(spark, sf)))


def seasonal_trend_strength(spark, sf):
    return emit(diagnostics.strength(clean_table(spark, sf)))


def clean_daily(spark, sf):
    return emit(clean(spark, sf))


def clean_dirty_daily(spark, sf):
    return emit(clean_dirty(spark, sf))


def realism_profile(spark, sf):
    return emit(diagnostics.realism_profile(clean_table(spark, sf)))


def _feature_columns(names):
    def query(spark, sf):
        return emit(features(spark, sf).select("series_id", "date", *names))
    return query


def exog_fill_bfill(spark, sf):
    return emit(feat.exog_fill_bfill(feat.exog_matrix(feature_table(spark, sf))).drop("t"))


def _train_exog(spark, sf):
    feats = feature_table(spark, sf)
    blocks = splits.pct_split(feats).select("series_id", "train_size")
    exog = feat.exog_matrix(feats).join(blocks, "series_id")
    return feat.exog_fill_train_mean(exog, F.col("train_size"))


def exog_fill_trainmean(spark, sf):
    return emit(_train_exog(spark, sf).drop("t", "train_size"))


def scale_full(spark, sf):
    filled = feat.exog_fill_bfill(feat.exog_matrix(feature_table(spark, sf)))
    return emit(feat.scale_full(filled, feat.EXOG).drop("t"))


def scale_train(spark, sf):
    return emit(feat.scale_train(_train_exog(spark, sf), feat.EXOG, F.col("train_size")).drop("t", "train_size"))


def complete_rows(spark, sf):
    return emit(feat.complete_rows(feature_table(spark, sf)).drop("y"))


def backtest_window(spark, sf):
    return emit(splits.backtest_window(feature_table(spark, sf)))


def backtest_rejects(spark, sf):
    short = sources.short_history(spark.read.parquet(f"{sf}/events.parquet"))
    return emit(splits.backtest_window(short).filter(F.col("status") == "rejected"))


def pct_split(spark, sf):
    return emit(splits.pct_split(feature_table(spark, sf)))


def rolling_origin(spark, sf):
    feats = feature_table(spark, sf)
    return emit(splits.fold_summary(splits.with_split(feats, window(feats)), 14))


def time_series_folds(spark, sf):
    return emit(splits.time_series_folds(feat.complete_rows(feature_table(spark, sf))))


QUERIES = {f.__name__: f for f in [
    daily_source, schema_conform, short_history, report_sink,
    drop_bad_dates, conflicting_dates, dup_removed, dedup_daily, calendar_complete, calendar_rejects, calendar_complete_far,
    coerce_numeric, negatives_to_null, null_run_length, ffill_short, interpolate_short, fill_past_only,
    imputed_flag, long_gap_cells, high_outlier_flag, calendar_cols, federal_holidays,
    inventory_reconcile, decensor_demand, demand_outlier_mad, usage_avg_7d, cleaning_report,
    df_stationarity, seasonal_trend_strength, clean_daily, clean_dirty_daily, realism_profile,
    exog_fill_bfill, exog_fill_trainmean, scale_full, scale_train, complete_rows,
    backtest_window, backtest_rejects, pct_split, rolling_origin, time_series_folds,
]}
QUERIES.update({
    "feat_lags": _feature_columns(feat.LAG_FEATURES),
    "feat_roll_mean": _feature_columns(["roll7_mean"]),
    "feat_roll_std": _feature_columns(["roll7_std"]),
    "feat_dow": _feature_columns(feat.DOW_FEATURES),
    "feat_season": _feature_columns(feat.SEASON_FEATURES),
    "feat_known": _feature_columns(feat.KNOWN_FEATURES),
    "feat_driver_lag1": _feature_columns(feat.DRIVER_FEATURES),
    "build_features": _feature_columns(["t", "y", *feat.FEATURES]),
    "exog_matrix": _feature_columns(feat.EXOG),
})
