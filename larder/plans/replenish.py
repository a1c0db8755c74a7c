"""One job from raw rows to orders: clean, select a model, order on its forecast, say what drives it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators import elastic, policy, splits, trees
from larder.operators.features import build_features
from larder.plans.cleaning import clean_marked, cleaning_report
from larder.plans.selection import Settings, model_selection
from larder.session import stored_by


def whole_history(features: DataFrame) -> DataFrame:
    """The pooled training table with every row before the test block, which is empty."""
    counts = features.groupBy("series_id").agg(F.count(F.lit(1)).alias("n")).withColumn("t0", F.col("n"))
    return trees.training_table(splits.with_split(features, counts))


def explain_winners(features: DataFrame, winners: DataFrame, s: Settings | None = None) -> DataFrame:
    """``series_id, winner, explained_by, name, value``: what drives demand, told by the model that won.

    A winning tree model is explained by its own importances.  Any other winner (smoothing, the ensemble, a
    baseline) has no weights for the drivers, so the elastic net of the same rows speaks for it.  The models are pooled, so
    there is one fit for each model that won anywhere, whatever the number of series; the driver sees the distinct
    names of winners only, at most as many as the registry holds.
    """
    s = s or Settings()
    table = stored_by(whole_history(features), "history")
    own = {m.name: m for m in (s.gbt, s.forest, s.gbt_leafwise)}
    won = {r["winner"] for r in winners.select("winner").distinct().collect()}
    parts = [trees.importances(table, own[name]).withColumn("explained_by", F.lit(name)) for name in sorted(won & set(own))]
    if won - set(own):
        linear = elastic.standard_coefficients(table, elastic.choose(table, s.past_only_cv, s.n_alphas))
        parts.append(linear.withColumn("explained_by", F.lit("elasticnet")))
    if not parts:
        return winners.select("series_id", "winner", *[F.lit(None).cast(k).alias(n) for n, k in (
            ("explained_by", "string"), ("name", "string"), ("value", "double"))]).limit(0)
    weights = reduce(DataFrame.unionByName, parts)
    by = F.when(F.col("winner").isin(*own), F.col("winner")).otherwise("elasticnet")
    # A row for each series and feature; the weights are one row for each model that won and feature.
    return (winners.select("series_id", "winner", by.alias("explained_by")).join(weights, "explained_by")
            .select("series_id", "winner", "explained_by", "name", "value"))


def replenish(raw: DataFrame, test_days: int = 168, s: Settings | None = None,
              scenario: policy.Scenario = policy.Scenario(), explain: bool = True, **cleaning) -> dict[str, DataFrame]:
    """Raw daily rows to orders in one call.

    Returns ``clean``, ``report`` (what was repaired), all tables of ``model_selection``, ``orders`` (one row for each day
    of the back-test window, on the winner's forecast) and, unless ``explain`` is off, ``drivers``.  The clean and the
    feature table and the winner's forecasts are written once; every later step reads them.
    """
    marked = stored_by(clean_marked(raw, **cleaning), "marked")
    features = stored_by(build_features(marked), "features")
    found = model_selection(features, test_days, s)
    chosen = stored_by(found["chosen"], "chosen")
    winners = stored_by(found["winner"], "winner")
    out = {"clean": marked, "report": cleaning_report(marked), **found, "chosen": chosen, "winner": winners,
           "orders": policy.order_days(policy.chosen_forecast(marked, chosen), policy.stock_position(marked), scenario)}
    if explain:
        out["drivers"] = explain_winners(features, winners, s)
    return out
