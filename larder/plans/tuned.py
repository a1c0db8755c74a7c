"""Tune on a validation block, select on it, and score the test block once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators import elastic, linear, naive, scoring, smoothing, splits, trees, tuning
from larder.session import stored, stored_by


@dataclass
class TuningSettings:
    """Shares, cadence and number of trials."""

    test_frac: float = 0.15
    val_frac: float = 0.15
    refit_every: int = 14
    reestimate_every: int = 28
    pooled_refit_every: int = 14
    trials: dict[str, int] = field(default_factory=lambda: {"gbt": 40, "random_forest": 40, "gbt_leafwise": 40})
    seed: int = 42
    n_alphas: int = elastic.N_ALPHAS
    tree_models: list[trees.TreeModel] = field(
        default_factory=lambda: [trees.GBT, trees.FOREST, trees.GBT_LEAFWISE])


@dataclass(frozen=True)
class TreeSearch:
    """A search over one tree model: every trial, forecasts of those that came through, one adoption for all series."""

    base: trees.TreeModel
    trials: list[trees.Trial]
    forecasts: DataFrame
    adopted: DataFrame

    @property
    def chosen(self) -> trees.TreeModel:
        """The adopted setting under the model's own name."""
        config = self.adopted.first()["config"]  # one row: the choice for all series
        return next(t.model for t in self.trials if t.model.name == config).with_params(self.base.name)


REGISTRY = ["seasonal_naive", "holt_winters", "arx", "gbt", "elasticnet", "random_forest", "theta", "gbt_leafwise"]


def _keep(forecasts: DataFrame, adopted: DataFrame, name: str) -> DataFrame:
    """Forecasts of each series' adopted configuration, under the model's name."""
    chosen = adopted.select("series_id", F.col("config").alias("model"))
    return forecasts.join(chosen, ["series_id", "model"], "left_semi").withColumn("model", F.lit(name))


def tune_holt_winters(features: DataFrame, split: DataFrame, scale: DataFrame, refit_every: int = 14):
    """(forecasts of every variant, adoption per series)."""
    forecasts = stored(smoothing.holt_winters(features, split, refit_every, tuning.holt_winters_variants(), name=None), "tuning")
    return forecasts, tuning.adopt(scoring.score(forecasts, scale), smoothing.DEFAULT_VARIANT.name)


def tune_theta(features: DataFrame, split: DataFrame, scale: DataFrame):
    forecasts = stored(smoothing.theta(features, split, tuning.theta_forms(), name=None), "tuning")
    return forecasts, tuning.adopt(scoring.score(forecasts, scale), smoothing.DEFAULT_THETA.name)


def tune_arx(features: DataFrame, split: DataFrame, scale: DataFrame, refit_every: int = 28):
    forecasts = stored(linear.arx(features, split, refit_every, linear.ORDERS, name=None), "tuning")
    return forecasts, tuning.adopt(scoring.score(forecasts, scale), linear.order_name(*linear.DEFAULT_ORDER))


def tune_trees(table: DataFrame, split: DataFrame, scale: DataFrame, base: trees.TreeModel, s: TuningSettings) -> TreeSearch:
    """Search by rungs over drawn settings; models are pooled over series, so one is chosen for all, by the mean of the series' scores."""
    drawn = tuning.sample_params(base.name, s.trials.get(base.name, 0), s.seed)
    candidates = [base.with_params(f"trial_{i}", **tuning.learner_params(p)) for i, p in enumerate(drawn)]
    for c in candidates:
        c.estimator()  # a setting that the learner refuses ends the search before its first fit

    def score(forecasts: DataFrame) -> dict[str, float]:
        overall = scoring.score(forecasts, scale).groupBy("model").agg(F.avg("mase").alias("mase"))
        return {r.model: r.mase for r in overall.collect()}
    trials, forecasts = trees.halving(table, base.with_params("default"), candidates, s.pooled_refit_every,
                                      trees.folds_of(split, s.pooled_refit_every), score)
    through = max(t.folds for t in trials)
    scores = table.sparkSession.createDataFrame(
        [(t.model.name, t.mase) for t in trials if t.folds == through], "model string, mase double")
    return TreeSearch(base, trials, forecasts, stored(tuning.adopt(scores, "default", by=[]), "adopted"))


def leak_check(features: DataFrame, split: DataFrame, scale: DataFrame, refit_every: int = 14,
               n_alphas: int = elastic.N_ALPHAS) -> DataFrame:
    """The elastic net with mixed-time validation folds beside past-only ones, both scored on one block."""
    table = trees.training_table(splits.with_split(features, split))
    chosen = [elastic.choose(table, past, n_alphas, name=name).model for name, past in (("mixed_time", False), ("past_only", True))]
    forecasts = trees.tree_forecasts(table, chosen, refit_every, trees.folds_of(split, refit_every))
    return scoring.score(forecasts, scale).select(
        "series_id", F.col("model").alias("folds"), F.round("mase", 4).alias("mase"))


@dataclass(frozen=True)
class Block:
    """One block of a split by shares: its rows for the pooled models and the scale of its scores."""

    split: DataFrame
    scale: DataFrame
    table: DataFrame


def block(features: DataFrame, split: DataFrame) -> Block:
    return Block(split, stored_by(scoring.mase_scale(features, split), "scale"), trees.training_table(splits.with_split(features, split)))


def tuned_selection(features: DataFrame, s: TuningSettings | None = None,
                    search: Callable[[trees.TreeModel], TreeSearch] | None = None) -> dict[str, DataFrame]:
    """Split by share, tune and select on validation, score the test block once.

    ``features`` should be a stored table.  ``search`` may give the searches of the tree models if they were made before.
    """
    s = s or TuningSettings()
    blocks = stored_by(splits.pct_split(features, s.test_frac, s.val_frac), "blocks")
    val, test = splits.validation_split(blocks), splits.test_split(blocks)
    on_val, on_test = block(features, val), block(features, test)
    val_scale, test_scale = on_val.scale, on_test.scale
    search = search or (lambda base: tune_trees(on_val.table, val, val_scale, base, s))

    reports, val_parts, test_parts = [], [], []
    for split, parts in ((val, val_parts), (test, test_parts)):
        parts.append(naive.seasonal_naive(features, split))

    families: list[tuple[str, Callable, Callable]] = [
        ("holt_winters", lambda: tune_holt_winters(features, val, val_scale, s.refit_every),
         lambda _: smoothing.holt_winters(features, test, s.refit_every, tuning.holt_winters_variants(), name=None)),
        ("arx", lambda: tune_arx(features, val, val_scale, s.reestimate_every),
         lambda a: linear.arx(features, test, s.reestimate_every, linear.ORDERS, name=None,
                              only=a.select("series_id", F.col("config").alias("candidate")))),
        ("theta", lambda: tune_theta(features, val, val_scale),
         lambda _: smoothing.theta(features, test, tuning.theta_forms(), name=None)),
    ]
    for name, tune, final in families:
        forecasts, adopted = tune()
        adopted = stored(adopted, "adopted")
        reports.append(tuning.report_rows(name, adopted))
        val_parts.append(_keep(forecasts, adopted, name))
        test_parts.append(_keep(final(adopted), adopted, name))

    every = s.pooled_refit_every
    finals = [elastic.choose(on_val.table, True, s.n_alphas).model]
    val_parts.append(trees.tree_forecasts(on_val.table, finals, every, trees.folds_of(val, every)))
    for base in s.tree_models:
        found = search(base)
        reports.append(tuning.report_rows(base.name, found.adopted, {t.model.name: tuning.settings_text(t.model.params) for t in found.trials}))
        config = found.adopted.first()["config"]
        val_parts.append(found.forecasts.filter(F.col("model") == config).withColumn("model", F.lit(base.name)))
        finals.append(found.chosen)
    test_parts.append(trees.tree_forecasts(on_test.table, finals, every, trees.folds_of(test, every)))

    columns = ["series_id", "date", "model", "forecast", "actual"]
    val_all = stored_by(naive.union([p.select(*columns) for p in val_parts]), "val-forecasts")
    test_all = stored_by(naive.union([p.select(*columns) for p in test_parts]), "test-forecasts")
    selected = scoring.select_on_validation(val_all, val_scale, test_all, test_scale, REGISTRY)
    return {"selection": selected, "tuning_report": naive.union(reports), "test_forecasts": test_all,
            "split": blocks, "rejects": blocks.filter(F.col("status") == "rejected"),
            "test_scale": test_scale}
