"""Forecasters, folds and selection."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from larder.operators import elastic, linear, naive, scoring, smoothing, splits, trees, tuning
from larder.operators import features as feat
from larder.operators.features import build_features
from larder.plans import cleaning, selection
from registry.common import feature_table
from tests.conftest import SMALL, DATA


@pytest.fixture(scope="module")
def seasonal(spark):
    """Daily demand with a strong weekly pattern on top, with all features."""
    from larder.session import stored
    from larder.sources import lineitem
    lift = F.when(F.weekday("date") < 5, 60.0).otherwise(0.0)
    raw = lineitem.daily(spark, f"{DATA}/sf0.01").filter(F.col("series_id").isin("AF", "NO"))
    raw = raw.withColumns({c: F.col(c) + lift for c in ("units_used", "units_requested")})
    return stored(build_features(cleaning.clean_daily(raw)), "seasonal")


@pytest.fixture(scope="module")
def split(seasonal):
    return splits.usable(splits.backtest_window(seasonal))


def mean_mase(forecasts, seasonal, split):
    scored = scoring.score(forecasts, scoring.mase_scale(seasonal, split))
    return {r.model: r.m for r in scored.groupBy("model").agg(F.avg("mase").alias("m")).collect()}


def test_models_beat_the_baseline_on_weekly_demand(seasonal, split):
    quick = selection.Settings(
        refit_every=84, n_alphas=3, forest=trees.FOREST.with_params(numTrees=10, maxDepth=6),
        gbt=trees.GBT.with_params(maxIter=10), gbt_leafwise=trees.GBT_LEAFWISE.with_params(maxIter=10))
    result = selection.model_selection(seasonal, s=quick)
    scores = {r.model: r.m for r in result["scores"].groupBy("model").agg(F.avg("mase").alias("m")).collect()}
    assert set(scores) == {*selection.registry_names(quick), scoring.ENSEMBLE}
    baseline = scores.pop("seasonal_naive")
    assert all(m < baseline for m in scores.values()), (baseline, scores)
    assert result["forecasts"].groupBy("series_id", "model").count().filter("count <> 168").isEmpty()


def brute_elastic_net(x, y, alpha, l1, steps=4000):
    """Proximal gradient on the rows themselves."""
    x, y = x - x.mean(axis=0), y - y.mean()
    n = len(y)
    rate = 1.0 / (np.linalg.norm(x, 2) ** 2 / n + alpha * (1 - l1))
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        g = x.T @ (x @ b - y) / n + alpha * (1 - l1) * b
        z = b - rate * g
        b = np.sign(z) * np.maximum(np.abs(z) - rate * alpha * l1, 0)
    return b


def pooled_rows(spark, n=120, t0=100, seed=0):
    """A training table of one series with three columns that matter or not; the other features are noise or constant."""
    from pyspark.ml.feature import VectorAssembler
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, len(feat.FEATURES))) * np.linspace(0.5, 3, len(feat.FEATURES)) + 1
    x[:, 5] = 4.0
    y = x[:, :3] @ [2.0, 0.0, -1.0] + rng.normal(size=n)
    pdf = pd.DataFrame(x, columns=feat.FEATURES).assign(
        series_id="s", t=np.arange(n) + splits.WARMUP, n=n + splits.WARMUP, t0=t0 + splits.WARMUP, y=y, scale=1.0, label=y)
    pdf["date"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(pdf["t"], unit="D")
    table = VectorAssembler(inputCols=feat.FEATURES, outputCol="vec").transform(spark.createDataFrame(pdf))
    return table, x, y


@pytest.mark.parametrize("ratio", [0.1, 0.5, 1.0])
def test_elastic_net_against_brute_force(spark, ratio):
    """The learner with converted penalties minimises the same sum as proximal gradient steps on the rows."""
    table, x, y = pooled_rows(spark)
    keep = np.delete(np.arange(x.shape[1]), 5)
    z = (x[:, keep] - x[:, keep].mean(axis=0)) / x[:, keep].std(axis=0)
    for alpha in (0.02, 0.3):
        fitted = elastic.penalised(alpha, ratio, y.std()).estimator().fit(table)
        got = fitted.coefficients.toArray()
        assert got[5] == 0
        assert got[keep] * x[:, keep].std(axis=0) == pytest.approx(brute_elastic_net(z, y, alpha, ratio), abs=5e-3)


@pytest.mark.parametrize("past_only", [True, False])
def test_choice_has_the_least_validation_error(spark, past_only):
    table, x, y = pooled_rows(spark, 660, 600)
    choice = elastic.choose(table, past_only, n_alphas=3, ratios=(0.5, 1.0))
    assert len(choice.settings) == 6 and sum(c for *_, c in choice.settings) == 1
    train = 600  # rows before the test block
    size = train // 6 if past_only else train // 5
    for ratio, alpha, mse, _ in choice.settings:
        errors = []
        for k in range(5):
            held = np.arange(train - (5 - k) * size, train - (4 - k) * size) if past_only else np.arange(k * size, (k + 1) * size)
            rest = np.arange(held[0]) if past_only else np.setdiff1d(np.arange(train), held)
            sd = x[rest].std(axis=0)
            sd[sd < 1e-9] = 1
            z = (x - x[rest].mean(axis=0)) / sd
            # the learner converts by the deviation of all rows before the block
            whole, own = y[:train].std(), y[rest].std()
            absolute, square = alpha * ratio, alpha * (1 - ratio) * whole / own
            b = brute_elastic_net(z[rest], y[rest], absolute + square, absolute / (absolute + square))
            errors.append(np.mean((y[held] - y[rest].mean() - z[held] @ b) ** 2))
        assert mse == pytest.approx(np.mean(errors), rel=0.02)
    assert min(m for _, _, m, _ in choice.settings) == next(m for *_, m, c in choice.settings if c)


def test_choice_without_rows_or_variation(spark):
    table, _, _ = pooled_rows(spark)
    assert elastic.choose(table.limit(0)).settings == []
    flat = table.withColumn("label", F.lit(1.0))
    assert elastic.choose(flat).settings == [] and elastic.choose(flat).model.params["regParam"] == 0.0


def test_trials_that_score_worse_end_early(spark, monkeypatch):
    """Half of the trials go on to twice the folds; the default sees all of them; a fold is fitted once."""
    table, _, _ = pooled_rows(spark)
    jobs = []
    monkeypatch.setattr(trees, "fit_all", lambda t, wanted, every: (jobs.extend((m.name, f) for m, f in wanted), spark.createDataFrame(
        [(m.name, f) for m, f in wanted], "model string, fold int"))[1])
    order = {f"trial_{i}": float(i) for i in range(4)} | {"default": 9.0}
    trials, last = trees.halving(table, trees.GBT.with_params("default"), [trees.GBT.with_params(f"trial_{i}") for i in range(4)], 7, 8,
                                 lambda f: {r.model: order[r.model] for r in f.select("model").distinct().collect()})
    assert {t.model.name: t.folds for t in trials} == {"default": 8, "trial_0": 8, "trial_1": 4, "trial_2": 2, "trial_3": 2}
    assert len(jobs) == len(set(jobs)) == 8 + 8 + 4 + 2 + 2
    assert {r.model for r in last.collect()} == {"default", "trial_0"}


def test_every_day_has_a_forecast_row(spark):
    """A missing feature gives a NULL forecast; rows to learn from are counted for all folds at once."""
    table, _, _ = pooled_rows(spark)
    holes = table.withColumn("vec", F.when(F.col("t") % 5 != 0, F.col("vec")))
    counts = trees.trainable_rows(holes, 7, 3)
    assert counts == [holes.filter(f"t < {114 + 7 * f} AND t % 5 <> 0").count() for f in range(3)]
    got = trees.tree_forecasts(holes, [elastic.penalised(0.1, 0.5, 1.0)], 7, 3).collect()
    assert len(got) == 20 and sum(r.forecast is None for r in got) == 4
    none = trees.tree_forecasts(table.withColumn("label", F.lit(None).cast("double")), [trees.GBT], 7, 3)
    assert none.count() == 20 and none.filter("forecast IS NOT NULL").isEmpty()


def test_fits_read_partitions_by_rows_not_by_files(spark, monkeypatch):
    rows = spark.range(1000).repartition(90)
    least = 2 * spark.sparkContext.defaultParallelism
    assert trees.for_fits(rows, 1000).rdd.getNumPartitions() == least
    monkeypatch.setattr(trees, "ROWS_A_TASK", 50)
    assert trees.for_fits(rows, 1000).rdd.getNumPartitions() == 20
    assert trees.for_fits(rows, 1000).count() == 1000


def test_days_without_a_forecast_come_from_one_scan(spark, seasonal, split):
    table = trees.training_table(splits.with_split(seasonal, split))
    bare = table.withColumn("vec", F.when(F.col("t") % 2 == 0, F.col("vec")))
    jobs = [(trees.GBT, f) for f in range(4)] + [(trees.FOREST, f) for f in range(4)]
    rows = [0, 5, 5, 5]  # nothing to learn from in the first fold
    found = trees._unknown(bare, jobs, rows, 42)
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    test_days = bare.filter(F.col("t") >= F.col("t0"))
    first = test_days.filter(F.col("t") < F.col("t0") + 42).count()
    missing = test_days.filter((F.col("t") >= F.col("t0") + 42) & F.col("vec").isNull()).count()
    assert found.count() == 2 * (first + missing) == found.distinct().count()
    assert found.filter("forecast IS NOT NULL").isEmpty()


def test_arx_equals_least_squares_on_the_rows(seasonal, split):
    got = linear.arx(seasonal, split, refit_every=400).filter("series_id = 'AF'").orderBy("date").toPandas()
    rows = seasonal.filter("series_id = 'AF'").orderBy("t").toPandas()
    t0 = split.filter("series_id = 'AF'").first()["t0"]
    y = rows["y"]
    d = y.diff()
    x = pd.concat([d.shift(1), d.shift(2), d.shift(7), d.shift(14), rows[feat.EXOG]], axis=1).astype(float)
    for c in feat.LAGGED_EXOG:
        x[c] = x[c].fillna(x[c][:t0].mean())
    train = slice(15, t0)  # the difference lagged by 14 days needs day 15
    design = np.column_stack([np.ones(len(x)), x])
    b = np.linalg.lstsq(design[train], d[train], rcond=None)[0]
    want = (y.shift(1) + design @ b)[t0:]
    assert got["forecast"].to_numpy() == pytest.approx(want.to_numpy(), rel=1e-5)


def hw_brute(y, a, b, g):
    level = np.mean(y[:7])
    trend = (np.mean(y[7:14]) - level) / 7
    season = [v - level for v in y[:7]]
    out = []
    for t, v in enumerate(y):
        s = season[t % 7]
        out.append(level + trend + s)
        new = a * (v - s) + (1 - a) * (level + trend)
        season[t % 7] = g * (v - level - trend) + (1 - g) * s
        trend = b * (new - level) + (1 - b) * trend
        level = new
    return np.array(out)


def test_holt_winters_lanes_do_not_mix():
    rng = np.random.default_rng(1)
    y = rng.integers(1, 100, (80, 3)).astype(float)
    grid = [(0.3, 0.05, 0.2, 1.0), (0.1, 0.0, 0.4, 1.0)]
    out = smoothing.holt_winters_days(y, grid)
    for lane in range(3):
        for w, (a, b, g, _) in enumerate(grid):
            assert out[:, lane, w] == pytest.approx(hw_brute(y[:, lane], a, b, g))


def theta_brute(y, alpha, multiplicative):
    """Refit on the whole history of every day."""
    out = []
    for t in range(1, len(y)):
        h = y[:t]
        days = np.arange(t)
        slope = np.polyfit(days, h, 1)[0] if t > 1 else 0.0
        means = np.array([h[k::7].mean() if len(h[k::7]) else h.mean() for k in range(7)])
        flat = h / (means / h.mean())[days % 7] if multiplicative else h - (means - h.mean())[days % 7]
        level = flat[0]
        for v in flat[1:]:
            level += alpha * (v - level)
        plain = level + 0.5 * slope * (1 - (1 - alpha) ** t) / alpha
        k = t % 7
        out.append(plain * means[k] / h.mean() if multiplicative else plain + means[k] - h.mean())
    return np.array(out)


@pytest.mark.parametrize("method", ["additive", "multiplicative"])
def test_theta_daily_refit_against_brute_force(method):
    y = np.random.default_rng(2).integers(5, 60, 60).astype(float)
    out = smoothing.theta_days(y[:, None], smoothing.ThetaForm(True, method))
    for w in (0, 3):
        want = theta_brute(y, smoothing.THETA_LEVELS[w], method == "multiplicative")
        assert out[1:, 0, w] == pytest.approx(want)


def test_forecasts_and_features_do_not_look_ahead(spark, seasonal, split):
    """Changing every later value leaves features and forecasts up to that day as they were."""
    day = seasonal.agg(F.max("date")).first()[0]
    cut = F.lit(day) - F.expr("INTERVAL 60 DAY")
    later = F.col("date") >= cut
    base = seasonal.select("series_id", "date", "t", "y", *feat.FEATURES)
    changed_names = [c for c in ("y", *feat.EXOG)]
    changed = base.withColumns({c: F.when(later, F.col(c) * 3 + 17).otherwise(F.col(c)) for c in changed_names})
    for run in (lambda f: smoothing.holt_winters(f, split), lambda f: smoothing.theta(f, split),
                lambda f: linear.arx(f, split), lambda f: naive.seasonal_naive(f, split)):
        a, b = (run(f).filter(F.col("date") < cut).select("series_id", "date", F.round("forecast", 6).alias("f"))
                for f in (base, changed))
        assert a.count() > 100 and a.exceptAll(b).isEmpty()


def test_leaky_fills_and_scales_differ_from_the_past_only_ones(features):
    exog = feat.exog_matrix(features).withColumn("cut", F.lit(200))
    late = F.col("t") >= 200
    moved = exog.withColumns({c: F.when(late, F.col(c) + 1000).otherwise(F.col(c)) for c in feat.EXOG})

    def early(df):
        return df.filter(F.col("t") < 200).select("series_id", "date", *feat.EXOG)
    for leaks, fn in ((True, lambda d: feat.scale_full(d, feat.EXOG)),
                      (False, lambda d: feat.scale_train(d, feat.EXOG, F.col("cut"))),
                      (False, lambda d: feat.exog_fill_train_mean(d, F.col("cut")))):
        same = early(fn(exog)).exceptAll(early(fn(moved))).isEmpty()
        assert same != leaks
    gap = exog.withColumn("driver_lab_a_lag1", F.when(~F.col("t").between(190, 199), F.col("driver_lab_a_lag1")))
    gap_moved = gap.withColumn("driver_lab_a_lag1", F.col("driver_lab_a_lag1") + F.when(late, 1000).otherwise(0))
    assert not early(feat.exog_fill_bfill(gap)).exceptAll(early(feat.exog_fill_bfill(gap_moved))).isEmpty()


def test_trees_repeat_with_the_same_seed(seasonal, split):
    table = trees.training_table(splits.with_split(seasonal, split))
    model = trees.FOREST.with_params(numTrees=4, maxDepth=4)
    a, b = (trees.tree_forecasts(table, [model], 400, 1) for _ in range(2))
    assert a.exceptAll(b).isEmpty()


def test_user_model_joins_the_registry(features):
    def last_value(pdf):
        pdf = pdf.sort_values("t")
        pdf["forecast"], pdf["actual"], pdf["model"] = pdf["y"].shift(1), pdf["y"], "mine"
        return pdf[pdf["t"] >= pdf["t0"]][["series_id", "date", "model", "forecast", "actual"]]
    split = splits.usable(splits.backtest_window(features))
    run = selection.registry(selection.Settings(extra={"mine": selection.per_series_model(last_value)}))["mine"]
    assert run(features, split).count() == 6 * 168


def test_adoption_is_strict(spark):
    rows = [("a", "d", 1.0), ("a", "x", 1.0), ("b", "d", 1.0), ("b", "x", 0.9), ("c", "d", 0.5), ("c", "x", None)]
    out = {r.series_id: (r.adopted, r.config, r.best_mase) for r in tuning.adopt(
        spark.createDataFrame(rows, "series_id string, model string, mase double"), "d").collect()}
    assert out == {"a": (0, "d", 1.0), "b": (1, "x", 0.9), "c": (0, "d", 0.5)}


def test_search_spaces():
    for model in tuning.SPACES:
        drawn = tuning.sample_params(model, 25)
        assert drawn == tuning.sample_params(model, 25)
        for name, kind, low, high in tuning.SPACES[model]:
            assert all(low <= p[name] <= high for p in drawn)
            if kind == "int":
                assert all(isinstance(p[name], int) and p[name] < high for p in drawn)
        for p in drawn:
            learner = trees.TreeModel("m", "forest" if model == "random_forest" else "boost", tuning.learner_params(p))
            learner.estimator()
            assert "=" in tuning.settings_text(learner.params)


def test_equal_scores_go_to_the_earlier_model(spark):
    rows = [("a", "second", 0.3 + 1e-13), ("a", "first", 0.1 + 0.2 + 1e-12), ("b", "second", 0.2), ("b", "first", 0.4)]
    scores = spark.createDataFrame(rows, "series_id string, model string, mase double")
    assert {r.series_id: r.winner for r in scoring.winner(scores, ["first", "second"]).collect()} == {
        "a": "first", "b": "second"}


def test_feature_table_is_read_back_whole(spark, features):
    assert feature_table(spark, SMALL) is features
    assert features.columns[4:] == feat.FEATURES and len(feat.FEATURES) == 21


def test_a_flat_series_still_gets_a_winner(spark):
    rows = [("a", "seasonal_naive", None, 2.0), ("a", "m", None, 1.0), ("a", "k", None, None)]
    scores = spark.createDataFrame(rows, "series_id string, model string, mase double, mae double")
    assert [r.winner for r in scoring.winner(scores, ["seasonal_naive", "m", "k"]).collect()] == ["m"]
    assert [r.model for r in scoring.trimmed_members(scores).collect()] == ["m"]


def test_one_hot_day_is_reduced_before_the_exchange(spark):
    """Half of all raw rows are copies of one day; the plan combines them on the map side."""
    from larder.operators import rows
    raw = spark.range(20000).select(
        F.expr("IF(id >= 0, 'a', 'b')").alias("series_id"), F.expr("IF(id % 2 = 0, DATE'2024-01-01', date_add(DATE'2024-01-01', int(id % 97)))")
        .alias("date"), (F.col("id") % 3).alias("units_used"), F.col("id").alias("seq"))
    days = rows.rows_by_day(raw.repartition(8), "seq")
    assert days.count() == 97 and days.agg(F.sum("n_rows")).first()[0] == 20000
    plan = days._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_min") > plan.index("Exchange hashpartitioning(series_id")


def test_the_whole_path_of_penalties_is_tried(spark):
    """A hundred penalties for each ratio, each judged as a fit of the learner judges it."""
    table, _, y = pooled_rows(spark, 660, 600)
    choice = elastic.choose(table)
    assert len(choice.settings) == 7 * 100
    assert selection.Settings().n_alphas == elastic.N_ALPHAS == 100
    rows = table.withColumn("split", elastic.split_number(True)).filter("t < t0")
    for ratio, alpha, mse, _ in (choice.settings[0], choice.settings[350], choice.settings[-1]):
        model, errors = elastic.penalised(alpha, ratio, y[:600].std()).estimator(), []
        for s in range(5):
            found = model.fit(rows.filter(F.col("split") < s)).transform(rows.filter(F.col("split") == s))
            errors.append(found.agg(F.avg((F.col("_pred") - F.col("label")) ** 2)).first()[0])
        assert mse == pytest.approx(np.mean(errors), rel=1e-4)
