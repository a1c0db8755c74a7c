"""Search spaces, trials and the adoption rule."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators import linear, smoothing
from larder.operators.scoring import RANK_PLACES

# Fixed values: (setting, kind, low, high); integer ranges leave out the high end, "log" is uniform in log10.
BOOST_SPACE = [
    ("learning_rate", "log", 0.01, 0.3),
    ("reg_lambda", "log", 1e-3, 10.0),
    ("reg_alpha", "log", 1e-3, 10.0),
    ("max_depth", "int", 3, 11),
    ("min_child_weight", "int", 1, 11),
    ("subsample", "uniform", 0.6, 1.0),
    ("colsample_bytree", "uniform", 0.6, 1.0),
    ("n_estimators", "int", 200, 801),
]
FOREST_SPACE = [
    ("n_estimators", "int", 200, 801),
    ("max_depth", "int", 3, 21),
    ("max_features", "uniform", 0.3, 1.0),
    ("min_samples_leaf", "int", 1, 11),
]
LEAFWISE_SPACE = [
    ("learning_rate", "log", 0.01, 0.3),
    ("reg_lambda", "log", 1e-3, 10.0),
    ("num_leaves", "int", 15, 128),
    ("min_child_samples", "int", 5, 51),
    ("subsample", "uniform", 0.6, 1.0),
    ("colsample_bytree", "uniform", 0.6, 1.0),
    ("n_estimators", "int", 200, 801),
]
SPACES = {"gbt": BOOST_SPACE, "random_forest": FOREST_SPACE, "gbt_leafwise": LEAFWISE_SPACE}
# Each model draws from its own stream.
SEED_OFFSET = {"gbt": 0, "random_forest": 1, "gbt_leafwise": 2}


def sample_params(model: str, trials: int, seed: int = 42) -> list[dict]:
    """Seeded random settings, one dict per trial."""
    rng = np.random.default_rng(seed + SEED_OFFSET[model])

    def draw(kind: str, low: float, high: float):
        if kind == "int":
            return int(rng.integers(low, high))
        if kind == "log":
            return float(10 ** rng.uniform(math.log10(low), math.log10(high)))
        return float(rng.uniform(low, high))

    return [{name: draw(kind, low, high) for name, kind, low, high in SPACES[model]} for _ in range(trials)]


def learner_params(settings: dict) -> dict:
    """Settings as parameters of Spark's tree learners.

    The two penalty terms have no counterpart and are dropped; a number of leaves
    becomes the depth of a full tree with as many; rounds, trees and steps are taken as drawn.
    """
    renamed = {"learning_rate": "stepSize", "max_depth": "maxDepth", "min_child_weight": "minInstancesPerNode",
               "min_samples_leaf": "minInstancesPerNode", "min_child_samples": "minInstancesPerNode",
               "subsample": "subsamplingRate"}
    out = {renamed[k]: v for k, v in settings.items() if k in renamed}
    for share in ("colsample_bytree", "max_features"):
        if share in settings:
            out["featureSubsetStrategy"] = f"{settings[share]:.4f}"
    if "num_leaves" in settings:
        out["maxDepth"] = max(1, math.ceil(math.log2(settings["num_leaves"])))
    if "n_estimators" in settings:
        out["maxIter" if "learning_rate" in settings else "numTrees"] = settings["n_estimators"]
    return out


def trial_rows(series: DataFrame, models: list[str], trials: int, seed: int = 42) -> DataFrame:
    """The drawn settings beside every series they will be tried on, one row per setting."""
    rows = [(m, i, name, float(value)) for m in models
            for i, p in enumerate(sample_params(m, trials, seed)) for name, value in p.items()]
    names = ["model", "trial", "setting", "value"]
    columns = [F.lit(list(c)).alias(n) for n, c in zip(names, zip(*rows))]
    return series.select("series_id", F.inline(F.arrays_zip(*columns)))


def holt_winters_variants() -> list[smoothing.Variant]:
    return [smoothing.Variant(trend, multiplicative, damped)
            for trend in (True, False) for multiplicative in (False, True) for damped in (False, True)
            if trend or not damped]


def theta_forms() -> list[smoothing.ThetaForm]:
    return [smoothing.ThetaForm(True, "auto"), smoothing.ThetaForm(True, "additive"),
            smoothing.ThetaForm(True, "multiplicative"), smoothing.ThetaForm(False, "auto")]


def grid_params(features: DataFrame) -> DataFrame:
    """``series_id, model, config`` to try; multiplicative seasons only where every value is above 0."""
    rows = [("holt_winters", v.name, v.multiplicative) for v in holt_winters_variants()]
    rows += [("theta", f.name, False) for f in theta_forms()]
    rows += [("arx", linear.order_name(*o), False) for o in linear.ORDERS]
    options = F.inline(F.array(*[F.struct(
        F.lit(m).alias("model"), F.lit(c).alias("config"), F.lit(p).alias("needs_positive")) for m, c, p in rows]))
    positive = features.groupBy("series_id").agg(
        F.bool_and(F.coalesce(F.col("y") > 0, F.lit(False))).alias("_positive"))
    return (positive.select("series_id", "_positive", options)
            .filter(F.col("_positive") | ~F.col("needs_positive")).select("series_id", "model", "config"))


def adopt(scores: DataFrame, default: str, by: list[str] | None = None) -> DataFrame:
    """Adopt the best configuration only if it is strictly better than the default.

    ``scores`` has ``model`` (the configuration) and ``mase``; a configuration
    that failed has no score and cannot win.  Returns, per ``by``,
    ``default_mase, best_mase, adopted, config``.
    """
    keys = ["series_id"] if by is None else by
    mase = F.round("mase", RANK_PLACES)
    is_default = F.col("model") == default
    grouped = scores.groupBy(*keys).agg(
        F.max(F.when(is_default, F.col("mase"))).alias("default_mase"),
        F.min_by(F.struct("model", "mase"), F.when(~is_default, F.struct(mase.alias("m"), F.col("model")))).alias("_best"),
    )
    better = F.coalesce(
        F.round("_best.mase", RANK_PLACES) < F.round("default_mase", RANK_PLACES), F.col("default_mase").isNull())
    better = better & F.col("_best").isNotNull()
    return grouped.select(
        *keys, "default_mase", F.when(better, F.col("_best.mase")).otherwise(F.col("default_mase")).alias("best_mase"),
        better.cast("int").alias("adopted"),
        F.when(better, F.col("_best.model")).otherwise(F.lit(default)).alias("config"))


def settings_text(params: dict) -> str:
    """Learner settings in the order of their names."""
    return ", ".join(f"{k}={params[k]:.4g}" if isinstance(params[k], float) else f"{k}={params[k]}" for k in sorted(params))


def report_rows(model: str, adopted: DataFrame, settings: dict[str, str] | None = None) -> DataFrame:
    """Adoption results as rows of the tuning report; a choice made for all series has ``series_id`` NULL.

    ``settings`` spells a configuration out where its name does not.
    """
    series = F.col("series_id") if "series_id" in adopted.columns else F.lit(None).cast("string")
    spelt = F.col("config")
    if settings:
        spelt = F.element_at(F.create_map(*[F.lit(x) for kv in settings.items() for x in kv]), F.col("config"))
    return adopted.select(
        series.alias("series_id"), F.lit(model).alias("model"), F.round("default_mase", 4).alias("default_mase"),
        F.round("best_mase", 4).alias("best_mase"), "adopted", "config", spelt.alias("settings"))


def trial_table(spark: SparkSession, model: str, trials: list, adopted: str) -> DataFrame:
    """``model, config, settings, folds, mase, adopted``: a row for every setting of a search, given up early or not."""
    rows = [(model, t.model.name, settings_text(t.model.params), t.folds, t.mase, int(t.model.name == adopted)) for t in trials]
    return spark.createDataFrame(rows, "model string, config string, settings string, folds int, mase double, adopted int")
