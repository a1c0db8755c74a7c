"""Scores, the trimmed ensemble and the winner.

Forecasts are long: ``series_id, date, model, forecast, actual``.  The actual
travels with the forecast, so scoring needs no join of daily rows.  Models of a series are
compared on the same days: those on which there is an actual and every model has a forecast
(a model that never has one does not count, and has no score).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.columns import half_even
from larder.functions.windows import by_day
from larder.operators.splits import SEASON
from larder.session import stored_by

# Sums of doubles depend on the order rows arrive in; scores are ranked to this many places,
# so that equal forecasts tie.
RANK_PLACES = 9

BASELINE = "seasonal_naive"
ENSEMBLE = "avg_trimmed"


def mase_scale(features: DataFrame, split: DataFrame) -> DataFrame:
    """Per series: mean absolute change against a week earlier, before the test block."""
    error = F.abs(F.col("y") - F.lag("y", SEASON).over(by_day()))
    return (
        features.select("series_id", "date", "t", "y").withColumn("_e", error)
        .join(split, "series_id")
        .filter((F.col("t") >= SEASON) & (F.col("t") < F.col("t0")))
        .groupBy("series_id").agg(F.avg("_e").alias("q_scale"))
    )


def rank_of(registry: list[str]) -> Column:
    """Registry position of ``model``; the ensemble and unlisted models come last."""
    names = F.array(*[F.lit(m) for m in registry])
    position = F.array_position(names, F.col("model"))
    return F.when(position > 0, position).otherwise(len(registry) + 1).cast("int")


def on_common_days(forecasts: DataFrame) -> DataFrame:
    """``forecasts`` with ``common``: whether all models of the series can be scored on the row's day.

    Both windows are over a series, so one exchange serves them and the scores after them.
    """
    scored = F.when((F.col("actual") - F.col("forecast")).isNotNull(), F.col("model"))
    of_series = F.size(F.collect_set(scored).over(Window.partitionBy("series_id")))
    of_day = F.size(F.collect_set(scored).over(Window.partitionBy("series_id", "date")))
    counted = forecasts.withColumns({"_models": of_series}).withColumn("common", (F.col("_models") > 0) & (of_day == F.col("_models")))
    return counted.drop("_models")


def score(forecasts: DataFrame, scale: DataFrame) -> DataFrame:
    """``series_id, model, mase, mae, n_days`` on the common days; MASE is NULL where the scale is 0.

    ``forecasts`` may have ``common`` already, as when an ensemble joins the models it was made of.
    """
    marked = forecasts if "common" in forecasts.columns else on_common_days(forecasts)
    error = F.when(F.col("common"), F.abs(F.col("actual") - F.col("forecast")))
    errors = marked.groupBy("series_id", "model").agg(F.avg(error).alias("mae"), F.count(error).alias("n_days"))
    return errors.join(scale, "series_id").select(
        "series_id", "model", (F.col("mae") / F.nullif("q_scale", F.lit(0.0))).alias("mase"), "mae", "n_days")


def _merit(scores: DataFrame) -> Column:
    """What models of a series are ranked by.  Where the scale is 0 there is no MASE; MAE ranks the same."""
    merit = F.coalesce("mase", "mae") if "mae" in scores.columns else F.col("mase")
    return F.round(merit, RANK_PLACES)


def trimmed_members(scores: DataFrame, baseline: str = BASELINE) -> DataFrame:
    """Models strictly better than the baseline, per series; the baseline if none is.

    One aggregate per series keeps the model list (as long as the registry), so
    there is no self-join.
    """
    merit = _merit(scores)
    better = F.filter("_all", lambda m: (m["model"] != baseline) & (m["merit"] < F.col("_base")))
    kept = (
        scores.filter(F.col("model") != ENSEMBLE).groupBy("series_id").agg(
            F.collect_list(F.struct("model", merit.alias("merit"))).alias("_all"),
            F.max(F.when(F.col("model") == baseline, merit)).alias("_base"))
        .withColumn("_better", F.transform(better, lambda m: m["model"]))
    )
    chosen = F.when(F.size("_better") > 0, F.col("_better")).otherwise(F.array(F.lit(baseline)))
    return kept.select("series_id", F.explode(chosen).alias("model"))


def average(forecasts: DataFrame, members: DataFrame, name: str = ENSEMBLE) -> DataFrame:
    """Mean of the members' forecasts per day, as a model of its own.

    A day for which a member has no forecast, or no row, gets none.
    """
    of_series = members.groupBy("series_id").agg(F.collect_list("model").alias("_members"))  # as long as the registry
    mean = F.when(F.count("forecast") == F.max(F.size("_members")), F.avg("forecast"))
    common = {"common": F.bool_or("common")} if "common" in forecasts.columns else {}
    return (
        forecasts.join(of_series, "series_id").filter(F.array_contains("_members", F.col("model")))
        .groupBy("series_id", "date").agg(mean.alias("forecast"), F.max("actual").alias("actual"), *[c.alias(n) for n, c in common.items()])
        .select("series_id", "date", F.lit(name).alias("model"), "forecast", "actual", *common)
    )


def with_ensemble(forecasts: DataFrame, scale: DataFrame, members: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(forecasts with the ensemble and ``common``, scores of all, members); members follow from the scores unless given.

    The marked forecasts are written once, as scores, members and ensemble all read them.
    """
    marked = stored_by(on_common_days(forecasts), "forecasts")
    scores = score(marked, scale)
    members = members if members is not None else trimmed_members(scores)
    ensemble = average(marked, members)
    # scored apart, each where its rows lie: a union of rows would be exchanged again
    return marked.unionByName(ensemble, allowMissingColumns=True), scores.unionByName(score(ensemble, scale)), members


def winner(scores: DataFrame, registry: list[str]) -> DataFrame:
    """Lowest MASE per series; a tie goes to the earlier registry entry."""
    ranked = scores.withColumns({"_merit": _merit(scores), "_rank": rank_of(registry)})
    key = F.when(F.col("_merit").isNotNull(), F.struct("_merit", "_rank"))
    return ranked.groupBy("series_id").agg(
        F.min_by("model", key).alias("winner"), F.min_by("mase", key).alias("winner_mase"))


def score_table(scores: DataFrame, registry: list[str]) -> DataFrame:
    """Rounded scores in registry order."""
    return scores.select(
        "series_id", rank_of(registry).alias("rank"), "model",
        half_even(F.col("mase"), 3).alias("mase"), half_even(F.col("mae"), 2).alias("mae"))


def forecast_vs_actual(forecasts: DataFrame, winners: DataFrame) -> DataFrame:
    """The winner's forecast beside the actual."""
    return (
        forecasts.join(winners.select("series_id", "winner"), "series_id").filter(F.col("model") == F.col("winner"))
        .select("series_id", "date", "model", "actual", "forecast")
    )


def select_on_validation(val_forecasts: DataFrame, val_scale: DataFrame, test_forecasts: DataFrame,
                         test_scale: DataFrame, registry: list[str]) -> DataFrame:
    """Members and winner fixed on validation; the test block is scored once.

    Returns ``series_id, model, val_mase, test_mase, test_mae, is_member, is_winner``.
    """
    _, val_all, members = with_ensemble(val_forecasts, val_scale)
    members = stored_by(members, "members")
    _, test_all, _ = with_ensemble(test_forecasts, test_scale, members)
    # lists of a series' models, as long as the registry: every join is on the series alone, where the rows lie
    judged = val_all.groupBy("series_id").agg(F.collect_list(F.struct("model", "mase")).alias("_val"))
    chosen = members.groupBy("series_id").agg(F.collect_list("model").alias("_members"))
    own = F.filter("_val", lambda v: v["model"] == F.col("model"))
    return (
        test_all.select("series_id", "model", F.col("mase").alias("test_mase"), F.col("mae").alias("test_mae"))
        .join(judged, "series_id").filter(F.size(own) > 0)
        .join(chosen, "series_id", "left")
        .join(winner(val_all, registry).select("series_id", "winner"), "series_id")
        .select("series_id", "model", own[0]["mase"].alias("val_mase"), "test_mase", "test_mae",
                F.coalesce(F.array_contains("_members", F.col("model")), F.lit(False)).cast("int").alias("is_member"),
                (F.col("model") == F.col("winner")).cast("int").alias("is_winner"))
    )
