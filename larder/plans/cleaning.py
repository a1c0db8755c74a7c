"""The cleaning job: repair what is unambiguous, flag the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder import schema
from larder.functions.windows import whole
from larder.operators import calendar, checks, diagnostics, rows, values


def repair(raw: DataFrame, roles: dict[str, str] | None = None, max_gap_fill: int = 2,
           date_column: str = "date", sequence: str | None = None, past_only: bool = False,
           max_gap: int = rows.MAX_GAP) -> DataFrame:
    """Rows and values repaired, with the per-row marks the report counts.

    Two exchanges: raw copies are combined per (series, day), then the daily table
    is partitioned by series for every window that follows.
    """
    days = rows.rows_by_day(rows.parse_dates(raw, date_column), sequence)
    bad = F.coalesce(F.sum(F.when(F.col("date").isNull(), F.col("n_rows"))).over(whole()), F.lit(0))
    # A series' bad rows are one row here; their count moves to a column before the row is dropped.
    days = rows.drop_bad_dates(days.withColumn("bad_date_rows", bad.cast("bigint")))
    # So is the count of rows whose day is too far from the rest to belong to the series' calendar.
    far = F.coalesce(F.sum(F.when(~F.col("is_near"), F.col("n_rows"))).over(whole()), F.lit(0)).cast("bigint")
    days = (rows.with_span(days, max_gap).withColumn("far_rows", far).filter("is_near").drop("span", "is_near"))
    marks = ["n_rows", "has_conflict", "bad_date_rows", "far_rows"]
    numeric = schema.count_columns(days.columns, roles)
    carried = schema.carried_columns(numeric, roles)
    complete = rows.calendar_complete(days, max_gap=None)
    typed = values.negatives_to_null(values.coerce_numeric(complete, numeric), numeric)
    interpolated = [c for c in numeric if c not in carried]
    filled = values.fill_short_gaps(typed, carried, interpolated, max_gap_fill, past_only)
    missing = " + ".join(f"if(`{c}` IS NULL, 1, 0)" for c in numeric) or "0"
    return filled.withColumn("missing_cells", F.expr(missing)).withColumnsRenamed({m: f"_{m}" for m in marks})


def annotate(repaired: DataFrame, roles: dict[str, str] | None = None, outlier_k: float = 4.0,
             recon_tol: float = 1.0, high_mult: float = 5.0) -> DataFrame:
    """Calendar columns, checks, de-censored demand and flags.  Day-ordered windows come first,
    so they share one sort."""
    numeric = schema.count_columns(repaired.columns, roles)
    return (
        repaired.transform(calendar.calendar_columns)
        .transform(checks.inventory_reconcile, recon_tol)
        .transform(checks.decensor_demand)
        .transform(checks.usage_avg_7d)
        .transform(values.high_outlier_flag, numeric, high_mult)
        .transform(checks.demand_outlier_mad, outlier_k)
    )


_MARKS = ["_n_rows", "_has_conflict", "_bad_date_rows", "_far_rows", "is_inserted", "negative_cells",
          "missing_cells", "high_outlier_columns"]


def clean_marked(raw: DataFrame, roles: dict[str, str] | None = None, max_gap_fill: int = 2,
                 outlier_k: float = 4.0, recon_tol: float = 1.0, high_mult: float = 5.0,
                 date_column: str = "date", sequence: str | None = None,
                 past_only: bool = False, max_gap: int = rows.MAX_GAP) -> DataFrame:
    """``clean_daily`` with the marks ``cleaning_report`` counts."""
    return annotate(repair(raw, roles, max_gap_fill, date_column, sequence, past_only, max_gap),
                    roles, outlier_k, recon_tol, high_mult)


def clean_daily(raw: DataFrame, **options) -> DataFrame:
    """Clean a daily table; see ``clean_marked`` for the options."""
    return clean_marked(raw, **options).drop(*_MARKS)


def cleaning_report(marked: DataFrame, diagnose: bool = True) -> DataFrame:
    """One row per series from a ``clean_marked`` table.

    With ``diagnose`` the table is read three times; pass a stored one (``session.stored``).
    """
    mismatch = F.sum("inventory_mismatch") if "inventory_mismatch" in marked.columns else F.lit(None)
    shortage = F.sum("is_shortage") if "is_shortage" in marked.columns else F.lit(0)
    report = marked.groupBy("series_id").agg(
        F.max("_bad_date_rows").alias("rows_dropped_bad_date"),
        F.max("_far_rows").alias("rows_rejected_far_day"),
        F.sum(F.coalesce("_has_conflict", F.lit(0))).alias("conflicting_duplicate_dates"),
        F.sum(F.coalesce(F.col("_n_rows") - 1, F.lit(0))).alias("duplicate_dates_removed"),
        F.sum("is_inserted").alias("missing_calendar_days_inserted"),
        F.sum("negative_cells").alias("negative_values_fixed"),
        F.sum("row_was_imputed").alias("rows_short_gap_imputed"),
        F.sum("missing_cells").alias("cells_left_missing_long_gap"),
        F.sum("has_high_outlier").alias("high_value_outliers_flagged"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("high_outlier_columns"))))
        .alias("high_value_outlier_columns"),
        mismatch.cast("bigint").alias("inventory_mismatch_rows"),
        shortage.cast("bigint").alias("shortage_days_decensored"),
        F.sum("is_demand_outlier").alias("demand_outliers_flagged"),
    )
    if not diagnose:
        return report
    return (report.join(diagnostics.stationarity(marked).drop("n_steps"), "series_id", "left")
            .join(diagnostics.strength(marked), "series_id", "left"))
