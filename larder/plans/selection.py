"""Back-test every registered model, score, trim, pick a winner."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators import elastic, linear, naive, scoring, smoothing, splits, trees
from larder.session import stored_by

Forecaster = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass
class Settings:
    """Cadence and model settings of a back-test."""

    refit_every: int = 14
    reestimate_every: int = 28
    n_alphas: int = elastic.N_ALPHAS
    variant: smoothing.Variant = smoothing.DEFAULT_VARIANT
    theta: smoothing.ThetaForm = smoothing.DEFAULT_THETA
    order: tuple = linear.DEFAULT_ORDER
    forest: trees.TreeModel = trees.FOREST
    gbt: trees.TreeModel = trees.GBT
    gbt_leafwise: trees.TreeModel = trees.GBT_LEAFWISE
    past_only_cv: bool = True
    extra: dict[str, Forecaster] = field(default_factory=dict)


def registry(s: Settings) -> dict[str, Forecaster]:
    """Model name -> ``fn(features, split) -> long forecasts``; add a model through ``Settings.extra``."""
    def tree(model: trees.TreeModel) -> Forecaster:
        def run(features: DataFrame, split: DataFrame) -> DataFrame:
            table = trees.training_table(splits.with_split(features, split))
            return trees.tree_forecasts(table, [model], s.refit_every, trees.folds_of(split, s.refit_every))
        return run

    models: dict[str, Forecaster] = {
        "seasonal_naive": naive.seasonal_naive,
        "holt_winters": lambda f, p: smoothing.holt_winters(f, p, s.refit_every, [s.variant]),
        "arx": lambda f, p: linear.arx(f, p, s.reestimate_every, [s.order]),
        "gbt": tree(s.gbt),
        "elasticnet": lambda f, p: elastic.elastic_net(f, p, s.refit_every, s.past_only_cv, s.n_alphas),
        "random_forest": tree(s.forest),
        "theta": lambda f, p: smoothing.theta(f, p, [s.theta]),
        "gbt_leafwise": tree(s.gbt_leafwise),
    }
    return {**models, **s.extra}


def registry_names(s: Settings) -> list[str]:
    return list(registry(s))


def forecast_all(features: DataFrame, split: DataFrame, s: Settings | None = None) -> DataFrame:
    """One long forecast table of every registered model over the test block.

    The pooled models share one training table and one pool of fits.
    """
    s = s or Settings()
    table = trees.training_table(splits.with_split(features, split))
    pooled = [s.gbt, s.forest, s.gbt_leafwise, elastic.choose(table, s.past_only_cv, s.n_alphas).model]
    shared = {m.name for m in pooled}
    parts = [run(features, split) for name, run in registry(s).items() if name not in shared]
    parts.append(trees.tree_forecasts(table, pooled, s.refit_every, trees.folds_of(split, s.refit_every)))
    return naive.union([p.select("series_id", "date", "model", "forecast", "actual") for p in parts])


def model_selection(features: DataFrame, test_days: int = 168, s: Settings | None = None) -> dict[str, DataFrame]:
    """Forecasts, scores, members, winner and table over the last ``test_days`` days.

    ``features`` should be a stored table (``session.stored_by``), as every model reads
    it.  Series with too little history are in ``rejects``.  The winner is chosen
    on the block it is reported on; ``plans.tuned`` chooses on a validation block.
    """
    s = s or Settings()
    windows = splits.backtest_window(features, test_days)
    split = splits.usable(windows)
    forecasts = forecast_all(features, split, s)
    scale = stored_by(scoring.mase_scale(features, split), "scale")
    everything, scores, members = scoring.with_ensemble(forecasts, scale)
    names = registry_names(s)
    winners = scoring.winner(scores, names)
    everything = everything.drop("common")
    return {
        "forecasts": everything, "scores": scores, "members": members, "winner": winners,
        "table": scoring.score_table(scores, names),
        "chosen": scoring.forecast_vs_actual(everything, winners),
        "rejects": windows.filter(F.col("status") == "rejected"),
    }


def per_series_model(fn: Callable, schema: str = smoothing.LONG_SCHEMA) -> Forecaster:
    """A user's own pandas model as a registry entry.

    ``fn`` receives one series' features up to ``n`` with ``t0`` beside them and
    returns long forecasts of the days from ``t0``.
    """
    def run(features: DataFrame, split: DataFrame) -> DataFrame:
        return splits.with_split(features, split).groupBy("series_id").applyInPandas(fn, schema)
    return run
