"""One-row-per-series diagnostics and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.columns import flag, half_even, sum_columns
from larder.functions.windows import by_day, whole
from larder.schema import stock_columns_in

# Fixed value: 5% asymptotic critical value of the Dickey-Fuller t with a constant.
DICKEY_FULLER_5PCT = -2.86


def stationarity(df: DataFrame, column: str = "demand_model") -> DataFrame:
    """Dickey-Fuller regression of the daily change on yesterday's level, as aggregates."""
    steps = (df.filter(F.col(column).isNotNull())
             .withColumn("_x", F.lag(column).over(by_day()))
             .withColumn("_dy", F.col(column) - F.col("_x")))
    fits = steps.groupBy("series_id").agg(
        F.regr_count("_dy", "_x").alias("n_steps"),
        F.regr_slope("_dy", "_x").alias("_b"),
        F.regr_sxx("_dy", "_x").alias("_sxx"),
        F.regr_syy("_dy", "_x").alias("_syy"),
    )
    rss = F.col("_syy") - F.col("_b") * F.col("_b") * F.col("_sxx")
    se = F.sqrt(F.when((F.col("n_steps") > 2) & (F.col("_sxx") > 0) & (rss > 0),
                       rss / ((F.col("n_steps") - 2) * F.col("_sxx"))))
    return (fits.withColumn("df_t", F.col("_b") / se)
            .select("series_id", "n_steps", F.round("df_t", 4).alias("df_t"),
                    flag(F.col("df_t") < DICKEY_FULLER_5PCT).alias("is_stationary_5pct")))


def strength(df: DataFrame, column: str = "demand_model", period: int = 7) -> DataFrame:
    """Seasonal and trend strength from a centred moving average and weekday means.

    NULL where the series has fewer than two periods or the variance is zero.
    """
    half = period // 2
    around = by_day().rowsBetween(-half, period - 1 - half)
    present = df.filter(F.col(column).isNotNull()).withColumn("_n", F.count(F.lit(1)).over(whole()))
    parts = (
        present.withColumn("_trend", F.when(F.count(column).over(around) == period, F.avg(column).over(around)))
        .filter(F.col("_trend").isNotNull())
        .withColumn("_weekday", F.weekday("date"))
        .withColumn("_season", F.avg(F.col(column) - F.col("_trend")).over(whole("_weekday")))
        .withColumn("_resid", F.col(column) - F.col("_trend") - F.col("_season"))
    )
    var = parts.groupBy("series_id").agg(
        F.max("_n").alias("_n"),
        F.var_pop("_resid").alias("_r"),
        F.var_pop(F.col("_season") + F.col("_resid")).alias("_s"),
        F.var_pop(F.col("_trend") + F.col("_resid")).alias("_t"),
    )

    def share(total: Column) -> Column:
        enough = (F.col("_n") >= 2 * period) & (total > 0)
        return F.round(F.when(enough, F.greatest(F.lit(0.0), 1 - F.col("_r") / total)), 3)

    return var.select("series_id", share(F.col("_s")).alias("seasonal_strength"),
                      share(F.col("_t")).alias("trend_strength"))


def realism_profile(df: DataFrame) -> DataFrame:
    """Twelve measures that show whether a daily table behaves like real demand."""
    weekday, month = F.weekday("date"), F.month("date")
    used, requested = F.col("units_used"), F.col("units_requested")
    total = sum_columns([F.col(c) for c in stock_columns_in(df.columns)])
    prepared = df.withColumn("_total", total)
    prepared = prepared.withColumns({
        "_change": F.col("_total") - F.lag("_total").over(by_day()),
        "_first": F.lag("date").over(by_day()).isNull(),
    })
    flow = F.col("units_received") - used - F.col("units_expired")
    identity = F.col("_first") | F.coalesce(F.abs(F.col("_change") - flow) <= 1e-9, F.lit(False))

    def mean_used(cond: Column, name: str) -> Column:
        return half_even(F.avg(F.when(cond, used)), 2).alias(name)

    return prepared.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n_days"),
        mean_used(weekday < 5, "weekday_mean_used"),
        mean_used(weekday >= 5, "weekend_mean_used"),
        mean_used(month.isin(1, 2), "winter_mean_used"),
        mean_used(month.isin(7, 8), "summer_mean_used"),
        mean_used(F.col("is_holiday") == 1, "holiday_mean_used"),
        mean_used(F.col("is_holiday") == 0, "nonholiday_mean_used"),
        F.count_if(requested > used).alias("shortage_days"),
        half_even(100 * F.coalesce(F.sum("units_expired"), F.lit(0.0))
                  / F.greatest(F.coalesce(F.sum("units_received"), F.lit(0.0)), F.lit(1.0)), 2).alias("waste_pct"),
        F.bool_and(F.col("_total") >= 0).cast("int").alias("stock_never_negative"),
        F.bool_and(identity).cast("int").alias("inventory_identity_holds"),
        half_even(F.avg(flag(requested >= used)), 3).alias("requested_geq_used_share"),
    )
