"""Model features; every one is known before the day it describes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.windows import by_day, day_number, past, whole
from larder.operators.splits import WARMUP, fold_number
from larder.schema import LAGGED_DRIVERS

LAGS = [1, 7, 14]
LAG_FEATURES = [f"lag_{k}" for k in LAGS]
ROLL_FEATURES = ["roll7_mean", "roll7_std"]
DOW_FEATURES = [f"dow_{k}" for k in range(1, 7)]
SEASON_FEATURES = ["sin_year", "cos_year"]
KNOWN_FEATURES = ["is_holiday", "driver_scheduled"]
DRIVER_FEATURES = [f"{c}_lag1" for c in LAGGED_DRIVERS]
FEATURES = (LAG_FEATURES + ROLL_FEATURES + DOW_FEATURES + ["is_holiday"] + SEASON_FEATURES
            + ["driver_scheduled"] + DRIVER_FEATURES)

EXOG = ["is_holiday", "driver_scheduled", "driver_census_a_lag1", "driver_lab_a_lag1"]
LAGGED_EXOG = ["driver_census_a_lag1", "driver_lab_a_lag1"]


def _double(c: str) -> Column:
    return F.col(c).cast("double")


def lag_features() -> dict[str, Column]:
    return {f"lag_{k}": F.lag("demand_model", k).over(by_day()) for k in LAGS}


def roll_std() -> Column:
    """Sample deviation of the previous 7 days; all 7 must be present."""
    return F.when(F.count("demand_model").over(past(7)) == 7, F.stddev_samp("demand_model").over(past(7)))


def weekday_features() -> dict[str, Column]:
    """Monday is the reference day."""
    return {f"dow_{k}": F.expr(f"double(weekday(date) = {k})") for k in range(1, 7)}


def season_features() -> dict[str, Column]:
    angle = 2 * F.pi() * F.dayofyear("date") / 365
    return {"sin_year": F.sin(angle), "cos_year": F.cos(angle)}


def driver_features() -> dict[str, Column]:
    return {f"{c}_lag1": F.lag(c).over(by_day()) for c in LAGGED_DRIVERS}


def build_features(clean: DataFrame) -> DataFrame:
    """The 21 features beside ``series_id, date, t`` and the target ``y``, from one sort."""
    cols = {
        "t": day_number(),
        "y": _double("demand_model"),
        **lag_features(),
        "roll7_mean": F.col("usage_avg_7d"),
        "roll7_std": roll_std(),
        **weekday_features(),
        "is_holiday": _double("is_holiday"),
        **season_features(),
        "driver_scheduled": _double("driver_scheduled"),
        **driver_features(),
    }
    return clean.select("series_id", "date", *[c.alias(n) for n, c in cols.items()])


def complete_rows(features: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return features.dropna(how="any", subset=columns or FEATURES)


def exog_matrix(features: DataFrame) -> DataFrame:
    """The regressors of the autoregressive model."""
    return features.select("series_id", "date", "t", *EXOG)


def exog_fill_bfill(exog: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missing values from the next present one.  Leaks; kept for the comparison with the train mean.

    The next present value is the latest one in reversed day order: linear in the
    length of the series.
    """
    back = (Window.partitionBy("series_id").orderBy(F.desc("date"))
            .rowsBetween(Window.unboundedPreceding, 0))
    return exog.withColumns({c: F.last(c, ignorenulls=True).over(back) for c in columns or LAGGED_EXOG})


def exog_fill_train_mean(exog: DataFrame, train_end: Column, columns: list[str] | None = None) -> DataFrame:
    """Missing values from the mean of the rows before ``train_end``."""
    train = F.col("t") < train_end
    return exog.withColumns({
        c: F.coalesce(F.col(c), F.avg(F.when(train, F.col(c))).over(whole())) for c in columns or LAGGED_EXOG})


def scale_full(df: DataFrame, columns: list[str]) -> DataFrame:
    """Standardise on the whole series (sample deviation).  Leaks; kept for the comparison."""
    return df.withColumns({
        c: (F.col(c) - F.avg(c).over(whole())) / F.nullif(F.stddev_samp(c).over(whole()), F.lit(0.0))
        for c in columns})


def scale_train(df: DataFrame, columns: list[str], train_end: Column) -> DataFrame:
    """Standardise on the rows before ``train_end`` (population deviation, 0 becomes 1)."""
    def scaled(c: str) -> Column:
        seen = F.when(F.col("t") < train_end, F.col(c))
        sd = F.stddev_pop(seen).over(whole())
        return (F.col(c) - F.avg(seen).over(whole())) / F.when(sd == 0, F.lit(1.0)).otherwise(sd)
    return df.withColumns({c: scaled(c) for c in columns})


def scale_by_fold(split_features: DataFrame, columns: list[str], refit_every: int = 14) -> DataFrame:
    """Test-block rows with ``fold`` and their columns standardised on the complete rows that the fold's model learns from.

    Training sets of a rolling origin are nested, so the moments of a fold are running sums over blocks of days: the rows are
    reduced once (counts, sums and sums of squares, combined before the exchange), whatever the number of folds.  Values are
    shifted by the series' first complete row before they are squared, so that a large level costs no digits.  Sample deviation; 0 and
    an unknown one leave the column NULL.
    """
    per_series = Window.partitionBy("series_id")
    whole_row = F.expr(" AND ".join(f"{c} IS NOT NULL" for c in columns))
    usable = whole_row & (F.col("t") >= WARMUP)
    fold = F.greatest(fold_number(refit_every), F.lit(-1))
    rows = split_features.withColumns({"fold": fold, "_use": usable})
    origin = rows.filter("_use").groupBy("series_id").agg(*[F.min_by(c, "t").alias(f"_o_{c}") for c in columns])
    shifted = rows.join(origin, "series_id")
    at = {c: F.when(F.col("_use"), F.col(c) - F.col(f"_o_{c}")) for c in columns}
    blocks = shifted.groupBy("series_id", "fold").agg(
        F.count_if("_use").alias("_n"), *[F.sum(v).alias(f"_s_{c}") for c, v in at.items()], *[F.sum(v * v).alias(f"_q_{c}") for c, v in at.items()],
        *[F.first(f"_o_{c}").alias(f"_o_{c}") for c in columns])
    before = per_series.orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    sums = [f"_{k}_{c}" for k in "sq" for c in columns]
    running = blocks.withColumns({"_n": F.sum("_n").over(before), **{c: F.sum(c).over(before) for c in sums}}).filter("fold >= 0")
    days = rows.filter("fold >= 0").select("series_id", "date", "fold", *columns)

    def scaled(c: str) -> Column:
        n, s, q = F.col("_n"), F.col(f"_s_{c}"), F.col(f"_q_{c}")
        variance = F.when(n > 1, (q - s * s / n) / (n - 1))
        sd = F.when(variance > 1e-12, F.sqrt(variance))
        return ((F.col(c) - F.col(f"_o_{c}") - s / n) / sd).alias(c)
    return days.join(running, ["series_id", "fold"]).select("series_id", "date", "fold", *[scaled(c) for c in columns])
