"""Queries over scoring, ordering policy and stock."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions.labels import readable
from larder.functions.windows import day_number
from larder.operators import drivers, ledger, naive, policy, scoring, splits
from larder.schema import stock_columns
from larder.session import stored_by
from registry.common import clean_table, daily, emit, feature_table, policy_input, window

STOCK = stock_columns(5)
REGISTRY = ["seasonal_naive", "naive_1", "naive_14", "mean_7"]


def _base(spark, sf):
    return feature_table(spark, sf).select("series_id", "date", "t", "y")


def naive_forecasts(base):
    return naive.long_forecasts(base, {
        "seasonal_naive": naive.lag_forecast(7), "naive_1": naive.lag_forecast(1),
        "naive_14": naive.lag_forecast(14), "mean_7": naive.mean_forecast(7)})


def fc_seasonal_naive(spark, sf):
    base = _base(spark, sf)
    return emit(naive.seasonal_naive(base, window(base)))


def mase_scale(spark, sf):
    base = _base(spark, sf)
    return emit(scoring.mase_scale(base, window(base)))


def _forecasts(base, split):
    return naive.in_test_block(naive_forecasts(base), split).select(*naive.LONG)


def _scores(spark, sf):
    base = _base(spark, sf)
    split = window(base)
    forecasts = _forecasts(base, split)
    scale = scoring.mase_scale(base, split)
    return forecasts, scale, scoring.score(forecasts, scale)


def mase(spark, sf):
    return emit(_scores(spark, sf)[2].select("series_id", "model", "mase"))


def mae(spark, sf):
    return emit(_scores(spark, sf)[2].select("series_id", "model", "mae", "n_days"))


def trimmed_members(spark, sf):
    return emit(scoring.trimmed_members(_scores(spark, sf)[2]))


def avg_trimmed(spark, sf):
    forecasts, _, scores = _scores(spark, sf)
    return emit(scoring.average(forecasts, scoring.trimmed_members(scores)))


def _all_scores(spark, sf):
    base = _base(spark, sf)
    split = window(base)
    return scoring.with_ensemble(_forecasts(base, split), stored_by(scoring.mase_scale(base, split), "scale"))[:2]


def score_gaps(spark, sf):
    """Scores where one model has no row on some days and another no forecast: all are compared on the days that are left."""
    base = _base(spark, sf)
    split = window(base)
    day, model = F.dayofmonth("date"), F.col("model")
    holes = _forecasts(base, split).filter(~((model == "naive_14") & (day % 5 == 0))).withColumn(
        "forecast", F.when(~((model == "mean_7") & (day == 11)), F.col("forecast")))
    scores = scoring.with_ensemble(holes, scoring.mase_scale(base, split))[1]
    return emit(scores.select("series_id", "model", "mase", "mae", "n_days"))


def score_table(spark, sf):
    return emit(scoring.score_table(_all_scores(spark, sf)[1], REGISTRY))


def winner(spark, sf):
    return emit(scoring.winner(_all_scores(spark, sf)[1], REGISTRY))


def forecast_vs_actual(spark, sf):
    forecasts, scores = _all_scores(spark, sf)
    return emit(scoring.forecast_vs_actual(forecasts, scoring.winner(scores, REGISTRY)))


def winner_on_validation(spark, sf):
    base = _base(spark, sf)
    blocks = splits.pct_split(base)
    long = naive_forecasts(base)
    parts = {}
    for name, split in (("val", splits.validation_split(blocks)), ("test", splits.test_split(blocks))):
        parts[name] = naive.in_test_block(long, split).select(*naive.LONG), stored_by(scoring.mase_scale(base, split), "scale")
    return emit(scoring.select_on_validation(*parts["val"], *parts["test"], REGISTRY))


def fallback_forecast(spark, sf):
    return emit(policy_input(spark, sf))


def interval_error_std(spark, sf):
    return emit(policy.interval_error_std(policy_input(spark, sf), 3))


def _ordered(base):
    """Order-up-to on every recorded day: position = recorded stock, forecast = trailing mean."""
    return policy.order_days(policy.fallback_forecast(base), policy.stock_position(base))


def order_up_to(spark, sf):
    return emit(_ordered(clean_table(spark, sf)).select("series_id", "date", "position", "safety", "level", "order_qty"))


def order_up_to_short(spark, sf):
    """The same where one series has three days only: it keeps its rows."""
    base = clean_table(spark, sf).withColumn("t", day_number()).filter((F.col("series_id") != "AF") | (F.col("t") < 3))
    return emit(_ordered(base).select("series_id", "date", "position", "safety", "level", "order_qty"))


def order_on_winner(spark, sf):
    """Orders of the back-test window on the forecast of each series' winner."""
    forecasts, scores = _all_scores(spark, sf)
    chosen = scoring.forecast_vs_actual(forecasts, scoring.winner(scores, REGISTRY))
    base = clean_table(spark, sf)
    ordered = policy.order_days(policy.chosen_forecast(base, chosen), policy.stock_position(base))
    return emit(ordered.select("series_id", "date", "model", "forecast", "position", "safety", "level", "order_qty"))


def safety_stock(spark, sf):
    inputs = policy_input(spark, sf)
    errors = inputs.groupBy("series_id").agg(
        F.stddev_pop(F.col("demand") - F.col("forecast")).alias("sigma_1step"))
    both = errors.join(policy.interval_error_std(inputs, 3), "series_id", "left")
    levels = policy.with_scenarios(both, policy.service_level_scenarios())
    h = F.col("lead_time") + F.col("review")
    return emit(levels.select(
        "series_id", "service_level", "z",
        policy.safety_stock(F.col("z"), h, sigma_interval=F.col("sigma_interval")).alias("safety_interval"),
        policy.safety_stock(F.col("z"), h, sigma_1step=F.col("sigma_1step")).alias("safety_scaled")))


def blended_cover_cap(spark, sf):
    means = policy.with_scenarios(ledger.series_means(policy_input(spark, sf)), policy.mix_scenarios())
    cap = policy.blended_cover_cap(F.col("shelf_life"), F.col("shelf_life_long"), F.col("frac_long"))
    return emit(means.select(
        "series_id", "frac_long", cap.alias("cover_days"), (cap * F.col("mean_daily")).alias("cover_units")))


def expiry_first_issue(spark, sf):
    """Two pools from the recorded stock: a fifth of each age is long-life and two days fresher."""
    base = daily(spark, sf)
    slots = policy.issue_order(5, 7)
    cells = {}
    for pool, k in slots:
        if pool == "short":
            cells[pool, k] = F.col(f"stock_{k}day_left") - policy.half_even(F.col(f"stock_{k}day_left") * 0.2)
        else:
            cells[pool, k] = (policy.half_even(F.col(f"stock_{k - 2}day_left") * 0.2) if k > 2 else F.lit(0.0))
    wide = base.select("series_id", "date", F.col("units_requested").alias("need"),
                       *[c.alias(f"u_{pool}_{k}") for (pool, k), c in cells.items()])
    taken = policy.expiry_first_issue([F.col(f"u_{pool}_{k}") for pool, k in slots], F.col("need"))
    return emit(wide.select("series_id", "date", "need", *[
        t.alias(f"take_{pool}_{k}") for (pool, k), t in zip(slots, taken)]))


def oldest_first_issue(spark, sf):
    return emit(policy.oldest_first_issue(daily(spark, sf), F.col("units_requested")))


def stock_ageing(spark, sf):
    return emit(policy.stock_ageing(daily(spark, sf)))


def arrival_split(spark, sf):
    ordered = _ordered(clean_table(spark, sf))
    split = policy.arrival_split(ordered, 2, 0.05, policy.half_even(F.col("mean_daily")))
    return emit(split.select("series_id", "date", "arrived", "arrived_short", "arrived_long"))


def emergency_topup(spark, sf):
    base = clean_table(spark, sf)
    on_shelf = policy.sum_columns([F.col(c) for c in STOCK])
    return emit(base.select("series_id", "date", on_shelf.alias("on_shelf"), policy.emergency_topup(
        F.col("demand_model"), on_shelf, F.lit(10)).alias("courier")))


def stock_ledger(spark, sf):
    return emit(ledger.stock_ledger(policy_input(spark, sf), [policy.Scenario()]))


def policy_kpis(spark, sf):
    inputs = policy_input(spark, sf)
    book = ledger.stock_ledger(inputs, [policy.Scenario()])
    return emit(ledger.policy_kpis(book, ledger.series_means(inputs)))


def current_kpis(spark, sf):
    return emit(policy.current_kpis(clean_table(spark, sf)))


def policy_comparison(spark, sf):
    base = clean_table(spark, sf)
    inputs = policy.fallback_forecast(base)
    new = ledger.policy_kpis(ledger.stock_ledger(inputs, [policy.Scenario()]), ledger.series_means(inputs))
    return emit(policy.policy_comparison(policy.current_kpis(base), new))


def service_level_sweep(spark, sf):
    return emit(ledger.sweep(policy_input(spark, sf), policy.service_level_scenarios()))


def mix_sweep(spark, sf):
    return emit(ledger.sweep(policy_input(spark, sf), policy.mix_scenarios()))


def stock_over_time(spark, sf):
    book = ledger.stock_ledger(policy_input(spark, sf), [policy.Scenario()])
    return emit(ledger.stock_over_time(book, days=365, start=0))


def _coefficients(spark, sf):
    """Regression slopes of demand on each feature alone, standing in for model coefficients."""
    return drivers.single_slopes(feature_table(spark, sf))


def season_driver(spark, sf):
    return emit(drivers.merge_season(_coefficients(spark, sf)))


def top_drivers(spark, sf):
    merged = drivers.merge_season(_coefficients(spark, sf)).select("series_id", "name", "value")
    return emit(drivers.top_drivers(merged))


def driver_labels(spark, sf):
    return emit(_coefficients(spark, sf).select("series_id", "name", readable(F.col("name")).alias("label")))


QUERIES = {f.__name__: f for f in [
    fc_seasonal_naive, mase_scale, mase, mae, trimmed_members, avg_trimmed, score_table, score_gaps, winner,
    forecast_vs_actual, winner_on_validation, fallback_forecast, interval_error_std, order_up_to,
    order_up_to_short, order_on_winner, safety_stock,
    blended_cover_cap, expiry_first_issue, oldest_first_issue, stock_ageing, arrival_split, emergency_topup,
    stock_ledger, policy_kpis, current_kpis, policy_comparison, service_level_sweep, mix_sweep, stock_over_time,
    season_driver, top_drivers, driver_labels,
]}
