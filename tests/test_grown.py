"""Whole fits: rounds and trees as many as named, grown in one task as ``pyspark.ml`` grows them."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from larder.operators import features as feat
from larder.operators import grown, splits, trees, tuning
from larder.plans import replenish, tuned


def pooled(spark, n=160, t0=120, seed=3):
    """Two series of whole numbers, few of them distinct: every learner has the same thresholds to choose from."""
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 12, size=(2 * n, len(feat.FEATURES))).astype(float)
    y = 3 * x[:, 0] - 2 * x[:, 1] + (x[:, 2] > 5) * 7 + rng.integers(0, 5, 2 * n)
    t = np.tile(np.arange(n), 2) + splits.WARMUP
    pdf = pd.DataFrame(x, columns=feat.FEATURES).assign(
        series_id=np.repeat(["a", "b"], n), t=t, n=n + splits.WARMUP, t0=t0 + splits.WARMUP, y=y, scale=2.0, label=y / 2)
    pdf["date"] = (pd.Timestamp("2024-01-01") + pd.to_timedelta(pdf["t"], unit="D")).dt.date
    return VectorAssembler(inputCols=feat.FEATURES, outputCol="vec").transform(spark.createDataFrame(pdf))


def by_day(df):
    return {(r.series_id, r.date, r.model): r.forecast for r in df.collect()}


def test_default_models_take_all_their_rounds():
    assert [trees.GBT.params["maxIter"], trees.GBT_LEAFWISE.params["maxIter"], trees.FOREST.params["numTrees"]] == [300] * 3
    assert trees.GBT.params["stepSize"] == trees.GBT_LEAFWISE.params["stepSize"] == 0.05


def test_drivers_come_from_whole_models(spark, monkeypatch):
    """The model that explains a winner has all its rounds."""
    fitted = []
    monkeypatch.setattr(trees, "importances", lambda t, m: fitted.append(m) or spark.createDataFrame([("x", 1.0)], "name string, value double"))
    monkeypatch.setattr(replenish, "whole_history", lambda f: f)
    monkeypatch.setattr(replenish, "stored_by", lambda df, label: df)
    winners = spark.createDataFrame([("a", "gbt"), ("b", "random_forest"), ("c", "gbt_leafwise")], "series_id string, winner string")
    assert replenish.explain_winners(winners, winners).count() == 3
    assert sorted((m.name, m.params.get("maxIter", m.params.get("numTrees"))) for m in fitted) == [
        ("gbt", 300), ("gbt_leafwise", 300), ("random_forest", 300)]


@pytest.mark.parametrize("model", [
    trees.TreeModel("m", "forest", {"numTrees": 1, "maxDepth": 5, "minInstancesPerNode": 3, "featureSubsetStrategy": "all", "bootstrap": False}),
    trees.TreeModel("m", "boost", {"maxIter": 12, "maxDepth": 3, "minInstancesPerNode": 10, "stepSize": 0.1, "featureSubsetStrategy": "all"})])
def test_one_task_grows_what_spark_grows(spark, monkeypatch, model):
    """Without draws both ways give the same forecasts and importances (with enough rows a node that no two columns part them alike)."""
    table = pooled(spark)
    near, near_weights = by_day(trees.tree_forecasts(table, [model], 20, 2)), trees.importances(table, model).collect()
    monkeypatch.setattr(trees, "ROWS_IN_ONE", 0)
    far, far_weights = by_day(trees.tree_forecasts(table, [model], 20, 2)), trees.importances(table, model).collect()
    assert len(near) == 80 and near.keys() == far.keys()
    assert [near[k] for k in near] == pytest.approx([far[k] for k in near], rel=1e-6)
    assert [tuple(r) for r in near_weights] == [(n, pytest.approx(v, abs=1e-6)) for n, v in far_weights]


def test_small_fits_start_no_job_each(spark, monkeypatch):
    """All fits that one task holds are tasks of one job; a larger one goes to ``pyspark.ml``."""
    table, small = pooled(spark), trees.GBT.with_params(maxIter=2)
    sent = []
    whole = trees._fitted
    monkeypatch.setattr(trees, "_fitted", lambda t, m, fold, every, count: sent.append((fold, count)) or whole(t, m, fold, every, count))
    trees.tree_forecasts(table, [small], 20, 2)
    assert sent == []
    monkeypatch.setattr(trees, "ROWS_IN_ONE", 250)
    assert trees.tree_forecasts(table, [small], 20, 2).filter("forecast IS NOT NULL").count() == 80
    assert sent == [(1, 280)]


def test_days_of_every_fold_and_series_get_the_model_of_their_past(spark):
    """A fold learns from the past of those series only that go on past its start; rows without a label are forecast, not learned."""
    table = pooled(spark)
    table = table.withColumn("n", F.when(F.col("series_id") == "b", 130 + splits.WARMUP).otherwise(F.col("n"))).filter("t < n")
    table = table.withColumn("label", F.when(F.col("t") % 7 != 0, F.col("label")))
    mean = trees.TreeModel("m", "forest", {"numTrees": 1, "maxDepth": 0, "featureSubsetStrategy": "all", "bootstrap": False})
    got = by_day(trees.tree_forecasts(table, [mean], 20, 2))
    assert len(got) == 50 and None not in got.values()
    rows = table.filter("label IS NOT NULL").toPandas()
    for fold in (0, 1):
        start = 120 + splits.WARMUP + 20 * fold
        want = 2 * rows[(rows["t"] < start) & (start < rows["n"])]["label"].mean()
        days = {r.date for r in table.filter(f"t >= {start} AND t < {start + 20}").collect()}
        assert all(v == pytest.approx(want) for (_, d, _), v in got.items() if d in days)


def test_draws_do_not_follow_the_layout(spark):
    table = pooled(spark)
    a, b = (by_day(trees.tree_forecasts(table.repartition(k), [trees.GBT.with_params(maxIter=5)], 20, 2)) for k in (1, 7))
    assert a == b


@pytest.mark.parametrize("draw", ["all", "0.6"])
def test_nodes_of_few_rows_split_as_nodes_of_many(monkeypatch, draw):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 9, size=(300, 5)).astype(float)
    y = rng.integers(0, 50, 300).astype(float)
    params = {"numTrees": 6, "maxDepth": 9, "featureSubsetStrategy": draw}
    by_rows, by_bins = grown._Grower._by_rows, grown._Grower._by_bins
    monkeypatch.setattr(grown._Grower, "_by_rows", lambda self, *a: by_bins(self, *a[:-1]))
    want = grown.grow(x, y, x, "forest", params, 1)
    monkeypatch.setattr(grown._Grower, "_by_rows", by_rows)
    monkeypatch.setattr(grown._Grower, "_by_bins", lambda self, *a: by_rows(self, *a, np.argsort(a[6], axis=1, kind="stable")))
    got = grown.grow(x, y, x, "forest", params, 1)
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b)


def test_one_row_or_one_value():
    x, later = np.ones((1, 3)), np.zeros((2, 3))
    for kind, params in (("boost", {"subsamplingRate": 0.5}), ("forest", {})):
        found, weights = grown.grow(x, np.array([5.0]), later, kind, params, 1)
        assert found == pytest.approx([5.0, 5.0]) and not weights.any()


def test_drawn_settings_are_taken_whole():
    for model in tuning.SPACES:
        for drawn in tuning.sample_params(model, 40):
            params = tuning.learner_params(drawn)
            assert params["numTrees" if model == "random_forest" else "maxIter"] == drawn["n_estimators"] >= 200
            assert params.get("stepSize") == drawn.get("learning_rate")
            assert grown.known("forest" if model == "random_forest" else "boost", params)


def test_a_search_draws_forty_settings_and_refits_on_the_cadence_of_the_others(spark, monkeypatch):
    """What the reports and the selection take by default: 40 trials a model, a fold each 14 days."""
    s, asked = tuned.TuningSettings(), {}
    assert s.pooled_refit_every == s.refit_every == 14

    def halving(table, default, trials, refit_every, folds, score):
        asked[default.kind, default.params.get("maxDepth")] = (len(trials), refit_every, folds)
        return [trees.Trial(default, folds, 1.0)], table
    monkeypatch.setattr(trees, "halving", halving)
    table = pooled(spark)
    split = table.select("series_id", "n", "t0").distinct()
    for base in s.tree_models:
        tuned.tune_trees(table, split, table, base, s)
    assert list(asked.values()) == [(40, 14, 3)] * 3  # 40 days
