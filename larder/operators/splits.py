"""Back-test windows, percentage splits and rolling-origin folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.columns import half_even

WARMUP = 14
SEASON = 7
MIN_TRAIN = 35


def _lengths(df: DataFrame) -> DataFrame:
    return df.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))


def backtest_window(df: DataFrame, test_days: int = 168) -> DataFrame:
    """Per series: length ``n``, first test day ``t0`` and whether the history is long enough.

    A series that would train on fewer than 35 days is marked ``rejected``.
    """
    n = F.col("n")
    share = F.floor(F.lit(0.30) * n)
    test = F.greatest(F.lit(7), F.least(F.lit(int(test_days)), n - MIN_TRAIN, F.greatest(F.lit(14), share)))
    return (
        _lengths(df)
        .withColumn("test_days", test.cast("bigint"))
        .withColumn("t0", n - F.col("test_days"))
        .withColumn("status", F.when(F.col("t0") < MIN_TRAIN, "rejected").otherwise("ok"))
    )


def usable(windows: DataFrame) -> DataFrame:
    """Back-test splits of the series with enough history: ``series_id, n, t0``."""
    return windows.filter(F.col("status") == "ok").select("series_id", "n", "t0")


def pct_split(df: DataFrame, test_frac: float = 0.15, val_frac: float = 0.15) -> DataFrame:
    """Per series: sizes and starts of the train, validation and test blocks."""
    n = F.col("n")
    return (
        _lengths(df)
        .withColumn("test_size", half_even(n * F.lit(float(test_frac))).cast("bigint"))
        .withColumn("val_size", half_even(n * F.lit(float(val_frac))).cast("bigint"))
        .withColumn("train_size", n - F.col("val_size") - F.col("test_size"))
        .withColumn("test_start", F.col("train_size") + F.col("val_size"))
        .withColumn("status", F.when(F.col("train_size") < MIN_TRAIN, "rejected").otherwise("ok"))
    )


def validation_split(blocks: DataFrame) -> DataFrame:
    """``series_id, n, t0`` of a back-test over the validation block."""
    return blocks.filter(F.col("status") == "ok").select(
        "series_id", F.col("test_start").alias("n"), F.col("train_size").alias("t0"))


def test_split(blocks: DataFrame) -> DataFrame:
    """``series_id, n, t0`` of a back-test over the test block."""
    return blocks.filter(F.col("status") == "ok").select("series_id", "n", F.col("test_start").alias("t0"))


def with_split(features: DataFrame, split: DataFrame) -> DataFrame:
    """Features of the usable series, cut at ``n``, with ``t0`` beside every row.

    Both sides are partitioned by series, so the join adds no exchange of the
    features.
    """
    return features.join(split, "series_id").filter(F.col("t") < F.col("n"))


def fold_number(refit_every: int) -> Column:
    """Fold of a test day; negative before the test block."""
    return F.floor((F.col("t") - F.col("t0")) / F.lit(refit_every)).cast("int")


def fold_start(fold: Column, refit_every: int) -> Column:
    """End of the training rows of a fold, which is the fold's first day."""
    return F.col("t0") + fold * F.lit(refit_every)


def training_rows(split_features: DataFrame, fold: int, refit_every: int) -> DataFrame:
    """The expanding training set of one fold: a filter, so no row is copied per fold."""
    return split_features.filter(
        (F.col("t") >= WARMUP) & (F.col("t") < fold_start(F.lit(fold), refit_every))
        & (fold_start(F.lit(fold), refit_every) < F.col("n")))


def test_rows(split_features: DataFrame, fold: int, refit_every: int) -> DataFrame:
    """The days a fold's model forecasts."""
    return split_features.filter((F.col("t") >= F.col("t0")) & (fold_number(refit_every) == fold))


def fold_summary(split_features: DataFrame, refit_every: int = 14) -> DataFrame:
    """Per series and fold: first day, training rows and their target sum, test rows.

    Training sets of a rolling origin are nested, so their sums are running sums
    of block sums; joining every row to every later fold is not needed.
    """
    fold = F.greatest(fold_number(refit_every), F.lit(-1))
    trainable = F.col("t") >= WARMUP
    blocks = split_features.withColumn("fold", fold).groupBy("series_id", "t0", "fold").agg(
        F.count_if(trainable).alias("_rows"),
        F.sum(F.when(trainable, F.col("y"))).alias("_sum"),
        F.count(F.lit(1)).alias("n_test"),
    )
    from_start = (Window.partitionBy("series_id").orderBy("fold")
                  .rowsBetween(Window.unboundedPreceding, -1))
    return (
        blocks.withColumns({
            "n_train": F.sum("_rows").over(from_start),
            "sum_y_train": F.sum("_sum").over(from_start),
        })
        .filter(F.col("fold") >= 0)
        .select("series_id", "fold", fold_start(F.col("fold"), refit_every).alias("fold_start"),
                "n_train", "sum_y_train", "n_test")
    )


def time_series_folds(df: DataFrame, n_splits: int = 5) -> DataFrame:
    """Past-only folds: per series and fold the end of training and the test rows.

    Each test block holds n // (splits + 1) rows; the blocks are the last ones.
    """
    size = F.floor(F.col("n") / F.lit(n_splits + 1)).cast("bigint")
    folds = F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1)))
    first = F.col("n") - (F.lit(n_splits) - F.col("fold")) * F.col("_size")
    return (
        _lengths(df).withColumn("_size", size).withColumn("fold", folds)
        .select("series_id", "fold", first.alias("train_rows"), first.alias("test_start"),
                (first + F.col("_size")).alias("test_end"))
    )


def forecast_days(df: DataFrame) -> DataFrame:
    return df.filter((F.col("t") >= F.col("t0")) & (F.col("t") < F.col("n")))

