"""Queries that fit models, tune, select and stream."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from larder.operators import drivers, elastic, linear, naive, policy, scoring, smoothing, splits, trees, tuning
from larder.operators import features as feat
from larder.plans import replenish, selection, tuned
from larder.session import stored
from larder.streaming import feed, stateful
from registry.common import daily, emit, feature_table, policy_input, window
from registry.stock import naive_forecasts

# Registered queries run the library's own settings over whole tables.


def _test(spark, sf):
    feats = feature_table(spark, sf)
    return feats, window(feats)


def _validation(spark, sf):
    feats = feature_table(spark, sf)
    split = splits.validation_split(splits.pct_split(feats))
    return feats, split, scoring.mase_scale(feats, split)


def fc_holt_winters(spark, sf):
    feats, _ = _test(spark, sf)
    return emit(smoothing.holt_winters_fixed(feats, 0.3, 0.05, 0.2))


def fc_holt_winters_fit(spark, sf):
    return emit(smoothing.holt_winters(*_test(spark, sf)))


def fc_holt_winters_variants(spark, sf):
    return emit(smoothing.holt_winters(*_test(spark, sf), variants=tuning.holt_winters_variants(), name=None))


def fc_theta(spark, sf):
    return emit(smoothing.theta(*_test(spark, sf)))


def fc_arx(spark, sf):
    return emit(linear.arx(*_test(spark, sf)))


def fc_elasticnet(spark, sf):
    return emit(elastic.elastic_net(*_test(spark, sf)))


def elasticnet_choice(spark, sf):
    table = trees.training_table(splits.with_split(*_test(spark, sf)))
    return emit(elastic.settings_table(table, elastic.choose(table)))


def _tree(model):
    def query(spark, sf):
        feats, split = _test(spark, sf)
        table = trees.training_table(splits.with_split(feats, split))
        every = selection.Settings().refit_every
        return emit(trees.tree_forecasts(table, [model], every, trees.folds_of(split, every)))
    return query


def scale_features(spark, sf):
    """Features standardised on the rows before the test block by ``pyspark.ml``, per series mean of each."""
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array
    rows = splits.with_split(*_test(spark, sf)).dropna(how="any", subset=feat.FEATURES)
    vectors = VectorAssembler(inputCols=feat.FEATURES, outputCol="raw").transform(rows)
    fitted = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True).fit(
        vectors.filter((F.col("t") >= splits.WARMUP) & (F.col("t") < F.col("t0"))))
    scaled = fitted.transform(vectors).withColumn("s", vector_to_array("scaled"))
    return emit(scaled.select("series_id", "date", *[F.col("s")[i].alias(c) for i, c in enumerate(feat.FEATURES)]))


def scale_fold_features(spark, sf):
    return emit(feat.scale_by_fold(splits.with_split(*_test(spark, sf)), feat.FEATURES))


def forecast_all(spark, sf):
    return emit(selection.forecast_all(*_test(spark, sf)))


def model_selection(spark, sf):
    return emit(selection.model_selection(feature_table(spark, sf))["table"])


def sample_params(spark, sf):
    series = feature_table(spark, sf).select("series_id").distinct()
    return emit(tuning.trial_rows(series, ["gbt", "random_forest", "gbt_leafwise"], 40))


def grid_params(spark, sf):
    return emit(tuning.grid_params(feature_table(spark, sf)))


@lru_cache(maxsize=12)
def _search(spark, sf, name):
    """The search of one tree model, made once in a session: the reports read it too."""
    base = {m.name: m for m in tuned.TuningSettings().tree_models}[name]
    feats, split, _ = _validation(spark, sf)
    on = tuned.block(feats, split)
    return tuned.tune_trees(on.table, on.split, on.scale, base, tuned.TuningSettings())


def _tune_tree(name):
    def query(spark, sf):
        found = _search(spark, sf, name)
        return emit(tuning.trial_table(spark, name, found.trials, found.adopted.first()["config"]))
    return query


def tune_arx(spark, sf):
    return emit(tuning.report_rows("arx", tuned.tune_arx(*_validation(spark, sf))[1]))


def tune_holt_winters(spark, sf):
    return emit(tuning.report_rows("holt_winters", tuned.tune_holt_winters(*_validation(spark, sf))[1]))


def tune_theta(spark, sf):
    return emit(tuning.report_rows("theta", tuned.tune_theta(*_validation(spark, sf))[1]))


def adopt_rule(spark, sf):
    feats, split, scale = _validation(spark, sf)
    base = feats.select("series_id", "date", "t", "y")
    forecasts = naive.in_test_block(naive_forecasts(base), split).select(*naive.LONG)
    return emit(tuning.adopt(scoring.score(forecasts, scale), "mean_7"))


@lru_cache(maxsize=4)
def _tuned(spark, sf):
    return tuned.tuned_selection(feature_table(spark, sf), search=lambda base: _search(spark, sf, base.name))


def tuning_report(spark, sf):
    return emit(_tuned(spark, sf)["tuning_report"])


def tuned_selection(spark, sf):
    return emit(_tuned(spark, sf)["selection"])


def leak_check(spark, sf):
    feats = feature_table(spark, sf)
    split = splits.test_split(splits.pct_split(feats))
    return emit(tuned.leak_check(feats, split, scoring.mase_scale(feats, split)))


@lru_cache(maxsize=4)
def _replenished(spark, sf):
    return replenish.replenish(daily(spark, sf))


def replenish_orders(spark, sf):
    """Raw rows to orders on the forecast of the winner among all models."""
    found = _replenished(spark, sf)["orders"]
    return emit(found.select("series_id", "date", "model", "forecast", "position", "safety", "level", "order_qty"))


def replenish_drivers(spark, sf):
    return emit(_replenished(spark, sf)["drivers"])


def _whole_history(spark, sf):
    return replenish.whole_history(feature_table(spark, sf))


def driver_coefficients(spark, sf):
    table = _whole_history(spark, sf)
    return emit(elastic.standard_coefficients(table, elastic.choose(table)).withColumn("series_id", F.lit("all")))


def driver_importance(spark, sf):
    found = trees.importances(_whole_history(spark, sf), trees.FOREST).withColumn("series_id", F.lit("all"))
    return emit(drivers.top_drivers(drivers.merge_season(found, directional=False).select("series_id", "name", "value")))


def stream_daily_demand(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    stream, closing = feed.closing_feed(feed.read_files(spark, events, sf, pattern="events.parquet"), "ts")
    rolled = feed.daily_demand(stream, F.col("event_type"), {
        "units_used": F.count(F.lit(1)).cast("double"),
        "units_requested": F.count_if(F.col("value") > 50).cast("double")})
    return emit(feed.run_to_end(rolled, "daily", closing, one_batch=True))


def _as_stream(table, label):
    """A stream over a table's rows, written to files that are all there when it starts, and its end."""
    from larder.session import new_path
    path = new_path(table.sparkSession, label)
    table.write.parquet(path)
    return feed.closing_feed(feed.read_files(table.sparkSession, table, path), "date")


def stream_forecast(spark, sf):
    daily = feature_table(spark, sf).select("series_id", "date", "y")
    stream, closing = _as_stream(daily, "feed")
    return emit(feed.run_to_end(stateful.seasonal_naive(stream), "stream-forecast", closing, one_batch=True))


def stream_forecast_gaps(spark, sf):
    """The same on a feed as it may arrive: days without a row, days with two that differ, in any order."""
    daily = feature_table(spark, sf).select("series_id", "date", "y")
    day = F.dayofmonth("date")
    kept = daily.filter(~(day.between(4, 6) | ((day == 20) & (F.month("date") % 2 == 0))))
    again = kept.filter(day.isin(8, 9)).withColumn("y", F.when(day == 8, F.col("y") + 5).otherwise(F.col("y") - 3))
    stream, closing = _as_stream(kept.unionByName(again).repartition(8, "y"), "feed")
    return emit(feed.run_to_end(stateful.seasonal_naive(stream), "stream-gaps", closing, one_batch=True))


def stream_refit_cadence(spark, sf):
    feats, split = _test(spark, sf)
    weights = stored(smoothing.holt_winters_weights(feats, split), "weights")
    daily = feats.select("series_id", "date", "y")
    stream, closing = _as_stream(daily, "feed")
    return emit(feed.run_to_end(stateful.holt_winters(stream, weights), "stream-smoothing", closing, one_batch=True))


def stream_stock_ledger(spark, sf):
    inputs = policy_input(spark, sf)
    sigma = policy.interval_error_std(inputs, policy.Scenario().horizon)
    stream, closing = _as_stream(inputs.join(sigma, "series_id", "left"), "feed")
    return emit(feed.run_to_end(stateful.stock_ledger(stream), "stream-ledger", closing, one_batch=True))


QUERIES = {f.__name__: f for f in [
    fc_holt_winters, fc_holt_winters_fit, fc_holt_winters_variants, fc_arx, fc_elasticnet, elasticnet_choice,
    fc_theta, scale_features, scale_fold_features,
    forecast_all, model_selection, sample_params, grid_params, tune_arx,
    tune_holt_winters, tune_theta, adopt_rule, tuning_report, tuned_selection, leak_check, driver_coefficients,
    driver_importance, replenish_orders, replenish_drivers, stream_daily_demand, stream_forecast, stream_forecast_gaps, stream_refit_cadence, stream_stock_ledger,
]}
QUERIES.update({
    "fc_random_forest": _tree(trees.FOREST), "fc_gbt": _tree(trees.GBT), "fc_gbt_leafwise": _tree(trees.GBT_LEAFWISE),
    "tune_gbt": _tune_tree("gbt"), "tune_rf": _tune_tree("random_forest"), "tune_gbt_leafwise": _tune_tree("gbt_leafwise"),
})
