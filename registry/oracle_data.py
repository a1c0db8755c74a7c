"""SQL for the queries of ``registry.data``."""

from __future__ import annotations

from registry.sql import (CTES, DAILY_NUMBERS, DIRTY_NUMBERS, EXOG, FEATURES, KEYS, LAGGED, LAGGED_EXOG,
                          W, query, r, rounded)

CTES["d_conflicts"] = """
SELECT series_id, date, count(*) AS n_rows FROM d_dated WHERE date IS NOT NULL GROUP BY 1, 2
HAVING count(DISTINCT struct_pack(a := units_used, b := units_requested, c := driver_census_a)) > 1"""
CTES["d_counts"] = """
SELECT series_id, count(*) FILTER (WHERE date IS NULL) AS rows_dropped_bad_date,
  count(date) - count(DISTINCT date) AS duplicate_dates_removed FROM d_dated GROUP BY 1"""
CTES["d_counters"] = """
SELECT c.series_id, rows_dropped_bad_date, coalesce(k.n, 0) AS conflicting_duplicate_dates, duplicate_dates_removed
FROM d_counts c LEFT JOIN (SELECT series_id, count(*) AS n FROM d_conflicts GROUP BY 1) k USING (series_id)"""


def stationarity(table: str) -> str:
    return f"""
SELECT series_id, n_steps, round(b / se, 4) AS df_t, CAST(coalesce(b / se < -2.86, FALSE) AS INT) AS is_stationary_5pct
FROM (SELECT series_id, n_steps, b, sqrt((syy - b * b * sxx) / ((n_steps - 2) * sxx)) AS se
  FROM (SELECT series_id, CAST(regr_count(dy, x) AS BIGINT) AS n_steps, regr_slope(dy, x) AS b,
               regr_sxx(dy, x) AS sxx, regr_syy(dy, x) AS syy
    FROM (SELECT series_id, lag(demand_model) OVER ({W}) AS x, demand_model - lag(demand_model) OVER ({W}) AS dy
      FROM {table} WHERE demand_model IS NOT NULL) GROUP BY 1))"""


def strength(table: str) -> str:
    around = f"OVER ({W} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"
    return f"""
SELECT series_id,
  round(CASE WHEN n >= 14 AND vs > 0 THEN greatest(0.0::DOUBLE, 1 - vr / vs) END, 3) AS seasonal_strength,
  round(CASE WHEN n >= 14 AND vt > 0 THEN greatest(0.0::DOUBLE, 1 - vr / vt) END, 3) AS trend_strength
FROM (SELECT series_id, max(n) AS n, var_pop(y - trend - season) AS vr, var_pop(y - trend) AS vs,
             var_pop(y - season) AS vt
  FROM (SELECT *, avg(y - trend) OVER (PARTITION BY series_id, isodow(date)) AS season
    FROM (SELECT * FROM (
      SELECT series_id, date, demand_model AS y, count(*) OVER (PARTITION BY series_id) AS n,
        CASE WHEN count(demand_model) {around} = 7 THEN avg(demand_model) {around} END AS trend
      FROM {table} WHERE demand_model IS NOT NULL) WHERE trend IS NOT NULL)) GROUP BY 1)"""


CTES["d_station"] = stationarity("d_clean")
CTES["d_strength"] = strength("d_clean")


def spans(p: str, days: str) -> None:
    """Days of a series in spans; the one with most days stays, the earliest if several have."""
    CTES[f"{p}span"] = f"""
SELECT *, sum(CASE WHEN date - before > 3653 THEN 1 ELSE 0 END) OVER ({W}) AS span
FROM (SELECT *, lag(date) OVER ({W}) AS before FROM {days})"""
    CTES[f"{p}near"] = f"""
SELECT series_id, span FROM (SELECT series_id, span, row_number() OVER (PARTITION BY series_id ORDER BY count(*) DESC, span) AS rn
  FROM {p}span GROUP BY 1, 2) WHERE rn = 1"""


CTES["far_days"] = """
SELECT * FROM d_dedup UNION ALL
SELECT * EXCLUDE (stray) REPLACE (CAST(stray AS DATE) AS date) FROM (
  SELECT * FROM d_dedup QUALIFY date = min(date) OVER (PARTITION BY series_id)), (VALUES ('1066-10-14'), ('9999-12-31')) AS v(stray)"""
spans("far_", "far_days")
spans("d_all", "d_dedup")
CTES["far_kept"] = "SELECT far_span.* FROM far_span JOIN far_near USING (series_id, span)"
CTES["d_far"] = """
SELECT series_id, CAST(count(*) FILTER (WHERE n.span IS NULL) AS BIGINT) AS rows_rejected_far_day
FROM d_dated JOIN d_allspan s USING (series_id, date) LEFT JOIN d_allnear n USING (series_id, span) GROUP BY 1"""
CTES["d_report"] = """
SELECT series_id, CAST(sum(is_inserted) AS BIGINT) AS missing_calendar_days_inserted,
  CAST(sum(negative_cells) AS BIGINT) AS negative_values_fixed,
  CAST(sum(row_was_imputed) AS BIGINT) AS rows_short_gap_imputed,
  CAST(sum(CAST(units_used IS NULL AS INT) + CAST(units_requested IS NULL AS INT)
       + CAST(driver_census_a IS NULL AS INT)) AS BIGINT) AS cells_left_missing_long_gap,
  CAST(sum(has_high_outlier) AS BIGINT) AS high_value_outliers_flagged,
  coalesce(array_to_string(list_sort(list_distinct(flatten(list(string_split(high_outlier_columns, ','))
    FILTER (WHERE high_outlier_columns <> '')))), ','), '') AS high_value_outlier_columns,
  CAST(NULL AS BIGINT) AS inventory_mismatch_rows,
  CAST(sum(is_shortage) AS BIGINT) AS shortage_days_decensored,
  CAST(sum(is_demand_outlier) AS BIGINT) AS demand_outliers_flagged
FROM d_clean GROUP BY 1"""

CLEAN_FLAGS = "row_was_imputed, day_of_week, is_weekend, is_holiday, is_shortage"

SQL = {
    "daily_source": query(f"SELECT {KEYS}, {rounded(DAILY_NUMBERS)} FROM daily"),
    "schema_conform": query(
        f"SELECT {KEYS}, {rounded(DAILY_NUMBERS)}, CAST(NULL AS DOUBLE) AS stock_6day_left, "
        "CAST(NULL AS DOUBLE) AS stock_7day_left, CAST(NULL AS VARCHAR) AS day_of_week, "
        "CAST(NULL AS INT) AS is_weekend, CAST(NULL AS INT) AS is_holiday FROM daily"),
    "short_history": query(
        "SELECT event_type AS series_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, CAST(count(*) AS DOUBLE) AS units_used, "
        "CAST(count(*) FILTER (WHERE value > 50) AS DOUBLE) AS units_requested FROM events GROUP BY 1, 2"),
    "drop_bad_dates": query(
        "SELECT series_id, count(*) AS rows_in, count(*) FILTER (WHERE date IS NULL) AS rows_dropped_bad_date "
        "FROM d_dated GROUP BY 1"),
    "conflicting_dates": query(f"SELECT {KEYS}, n_rows FROM d_conflicts"),
    "dup_removed": query("SELECT * FROM d_counters"),
    "dedup_daily": query(f"SELECT {KEYS}, units_used, {rounded(['units_requested', 'driver_census_a'])} FROM d_dedup"),
    "calendar_complete": query(
        f"SELECT {KEYS}, units_used, {rounded(['units_requested', 'driver_census_a'])}, is_inserted FROM d_cal"),
    "calendar_rejects": query(
        "SELECT series_id, CAST(span AS INT) AS span, CAST(min(date) AS VARCHAR) AS first_day, CAST(max(date) AS VARCHAR) AS last_day, "
        "count(*) AS n_days FROM far_span LEFT JOIN (SELECT *, TRUE AS near FROM far_near) USING (series_id, span) "
        "WHERE near IS NULL GROUP BY 1, 2"),
    "calendar_complete_far": query(f"""
SELECT d.series_id, CAST(d.date AS VARCHAR) AS date, r.units_used, {r('r.units_requested', 'units_requested')},
  {r('r.driver_census_a', 'driver_census_a')}, CAST(r.series_id IS NULL AS INT) AS is_inserted
FROM (SELECT series_id, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date
  FROM far_kept GROUP BY 1) d LEFT JOIN far_kept r ON d.series_id = r.series_id AND d.date = r.date"""),
    "coerce_numeric": query(f"SELECT {KEYS}, {rounded(DIRTY_NUMBERS)} FROM d_num"),
    "negatives_to_null": query(f"SELECT {KEYS}, {rounded(DIRTY_NUMBERS)}, negative_cells FROM d_pos"),
    "null_run_length": query(f"SELECT {KEYS}, {', '.join('run_' + c for c in DIRTY_NUMBERS)} FROM d_runs"),
    "ffill_short": query(f"SELECT {KEYS}, {rounded(DIRTY_NUMBERS[:2])} FROM d_fill"),
    "interpolate_short": query(f"SELECT {KEYS}, {rounded(['driver_census_a'])} FROM d_fill"),
    "fill_past_only": query(
        f"SELECT {KEYS}, round(coalesce(driver_census_a, CASE WHEN run_driver_census_a <= 2 THEN "
        "round_even(pv_driver_census_a, 0) END), 6) + 0.0::DOUBLE AS driver_census_a FROM d_runs"),
    "imputed_flag": query(f"SELECT {KEYS}, row_was_imputed FROM d_fill"),
    "long_gap_cells": query("SELECT series_id, cells_left_missing_long_gap FROM d_report"),
    "high_outlier_flag": query(
        f"""SELECT {KEYS}, CAST(({' OR '.join(f'coalesce(p_{c} > 0 AND {c} > 5 * p_{c}, FALSE)' for c in DIRTY_NUMBERS)})
  AS INT) AS has_high_outlier,
  concat_ws(',', {', '.join(f"CASE WHEN p_{c} > 0 AND {c} > 5 * p_{c} THEN '{c}' END" for c in DIRTY_NUMBERS)})
  AS high_outlier_columns
FROM d_pos JOIN (SELECT series_id, {', '.join(f'quantile_cont({c}, 0.99) AS p_{c}' for c in DIRTY_NUMBERS)}
  FROM d_pos GROUP BY 1) USING (series_id)"""),
    "calendar_cols": query(f"SELECT {KEYS}, dayname(date) AS day_of_week, CAST(isodow(date) >= 6 AS INT) AS is_weekend FROM d_cal"),
    "federal_holidays": query(f"SELECT {KEYS}, CAST(date IN (SELECT date FROM holidays) AS INT) AS is_holiday FROM d_cal"),
    "inventory_reconcile": query(f"SELECT {KEYS}, inventory_mismatch FROM c_clean"),
    "decensor_demand": query(
        f"SELECT {KEYS}, CAST(coalesce(units_requested > units_used, FALSE) AS INT) AS is_shortage, "
        "round(CASE WHEN units_used IS NOT NULL AND units_requested IS NOT NULL "
        "THEN greatest(units_used, units_requested) END, 6) + 0.0::DOUBLE AS demand_model FROM d_pos"),
    "demand_outlier_mad": query(f"SELECT {KEYS}, {r('demand_model')}, is_demand_outlier FROM d_clean"),
    "usage_avg_7d": query(f"SELECT {KEYS}, {r('usage_avg_7d')} FROM d_clean"),
    "cleaning_report": query(
        "SELECT * FROM d_report JOIN d_counters USING (series_id) JOIN d_far USING (series_id) "
        "JOIN (SELECT series_id, df_t, is_stationary_5pct FROM d_station) USING (series_id) "
        "JOIN d_strength USING (series_id)"),
    "df_stationarity": query(stationarity("c_clean")),
    "seasonal_trend_strength": query(strength("c_clean")),
    "clean_daily": query(
        f"SELECT {KEYS}, {rounded(DAILY_NUMBERS)}, {CLEAN_FLAGS}, inventory_mismatch, has_high_outlier, "
        f"{rounded(['demand_model', 'usage_avg_7d'])}, is_demand_outlier FROM c_clean"),
    "clean_dirty_daily": query(
        f"SELECT {KEYS}, {rounded(DIRTY_NUMBERS)}, {CLEAN_FLAGS}, has_high_outlier, "
        f"{rounded(['demand_model', 'usage_avg_7d'])}, is_demand_outlier FROM d_clean"),
    "realism_profile": query(f"""
SELECT series_id, count(*) AS n_days,
  round_even(avg(CASE WHEN isodow(date) < 6 THEN units_used END), 2) AS weekday_mean_used,
  round_even(avg(CASE WHEN isodow(date) >= 6 THEN units_used END), 2) AS weekend_mean_used,
  round_even(avg(CASE WHEN month(date) IN (1, 2) THEN units_used END), 2) AS winter_mean_used,
  round_even(avg(CASE WHEN month(date) IN (7, 8) THEN units_used END), 2) AS summer_mean_used,
  round_even(avg(CASE WHEN is_holiday = 1 THEN units_used END), 2) AS holiday_mean_used,
  round_even(avg(CASE WHEN is_holiday = 0 THEN units_used END), 2) AS nonholiday_mean_used,
  count(*) FILTER (WHERE units_requested > units_used) AS shortage_days,
  round_even(100 * sum(units_expired) / greatest(sum(units_received), 1), 2) AS waste_pct,
  CAST(bool_and(total >= 0) AS INT) AS stock_never_negative,
  CAST(bool_and(first_day OR coalesce(abs(chg - (units_received - units_used - units_expired)) <= 1e-9, FALSE)) AS INT)
    AS inventory_identity_holds,
  round_even(avg(CASE WHEN units_requested >= units_used THEN 1.0::DOUBLE ELSE 0 END), 3) AS requested_geq_used_share
FROM (SELECT *, total - lag(total) OVER ({W}) AS chg, t = 0 AS first_day FROM c_clean) GROUP BY 1"""),
    "feat_lags": query(f"SELECT {KEYS}, {rounded(['lag_1', 'lag_7', 'lag_14'])} FROM feats"),
    "feat_roll_mean": query(f"SELECT {KEYS}, {rounded(['roll7_mean'])} FROM feats"),
    "feat_roll_std": query(f"SELECT {KEYS}, {rounded(['roll7_std'])} FROM feats"),
    "feat_dow": query(f"SELECT {KEYS}, {rounded([f'dow_{k}' for k in range(1, 7)])} FROM feats"),
    "feat_season": query(f"SELECT {KEYS}, {rounded(['sin_year', 'cos_year'])} FROM feats"),
    "feat_known": query(f"SELECT {KEYS}, {rounded(['is_holiday', 'driver_scheduled'])} FROM feats"),
    "feat_driver_lag1": query(f"SELECT {KEYS}, {rounded([c + '_lag1' for c in LAGGED])} FROM feats"),
    "build_features": query(f"SELECT {KEYS}, t, {rounded(['y', *FEATURES])} FROM feats"),
    "exog_matrix": query(f"SELECT {KEYS}, {rounded(EXOG)} FROM feats"),
    "complete_rows": query(
        f"SELECT {KEYS}, t, {rounded(FEATURES)} FROM feats WHERE {' AND '.join(f'{c} IS NOT NULL' for c in FEATURES)}"),
    "backtest_window": query("SELECT * FROM windows"),
    "backtest_rejects": query("""
SELECT *, n - test_days AS t0, 'rejected' AS status
FROM (SELECT *, CAST(greatest(7, least(168, n - 35, greatest(14, floor(CAST(0.3 AS DOUBLE) * n)))) AS BIGINT) AS test_days
  FROM (SELECT event_type AS series_id, count(DISTINCT CAST(ts AS DATE)) AS n FROM events GROUP BY 1))
WHERE n - test_days < 35"""),
    "pct_split": query("SELECT * FROM blocks"),
    "rolling_origin": query("""
SELECT series_id, fold, t0 + 14 * fold AS fold_start, count(*) FILTER (WHERE t >= 14 AND t < t0 + 14 * fold) AS n_train,
  round(sum(y) FILTER (WHERE t >= 14 AND t < t0 + 14 * fold), 6) + 0.0::DOUBLE AS sum_y_train,
  count(*) FILTER (WHERE t >= t0 + 14 * fold AND t < t0 + 14 * fold + 14) AS n_test
FROM feats JOIN usable USING (series_id), (SELECT CAST(unnest(generate_series(0, 11)) AS INT) AS fold)
WHERE t0 + 14 * fold < n GROUP BY ALL"""),
    "time_series_folds": query(f"""
SELECT series_id, fold, n - (5 - fold) * (n // 6) AS train_rows, n - (5 - fold) * (n // 6) AS test_start,
  n - (4 - fold) * (n // 6) AS test_end
FROM (SELECT series_id, count(*) AS n FROM feats WHERE {' AND '.join(f'{c} IS NOT NULL' for c in FEATURES)} GROUP BY 1),
  (SELECT CAST(unnest(generate_series(0, 4)) AS INT) AS fold)"""),
}

CTES["x_bfill"] = f"""
SELECT series_id, date, t, is_holiday, driver_scheduled, {', '.join(
    f'first_value({c} IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS {c}'
    for c in LAGGED_EXOG)} FROM feats"""
CTES["x_mean"] = f"""
SELECT series_id, date, t, train_size, is_holiday, driver_scheduled, {', '.join(
    f'coalesce({c}, avg({c}) FILTER (WHERE t < train_size) OVER (PARTITION BY series_id)) AS {c}'
    for c in LAGGED_EXOG)} FROM feats JOIN blocks USING (series_id)"""
SQL |= {
    "exog_fill_bfill": query(f"SELECT {KEYS}, {rounded(EXOG)} FROM x_bfill"),
    "exog_fill_trainmean": query(f"SELECT {KEYS}, {rounded(EXOG)} FROM x_mean"),
    "scale_full": query(f"""SELECT {KEYS}, {', '.join(
        f'round(({c} - avg({c}) OVER (PARTITION BY series_id)) / nullif(stddev_samp({c}) OVER (PARTITION BY series_id), 0), 6) + 0.0::DOUBLE AS {c}'
        for c in EXOG)} FROM x_bfill"""),
    "scale_train": query(f"""SELECT {KEYS}, {', '.join(
        f'round(({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END, 6) + 0.0::DOUBLE AS {c}' for c in EXOG)}
FROM x_mean JOIN (SELECT series_id, {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in EXOG)}
  FROM x_mean WHERE t < train_size GROUP BY 1) USING (series_id)"""),
}
SQL["report_sink"] = SQL["realism_profile"]
