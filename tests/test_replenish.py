"""Orders on a selection's forecast against plain Python; what drives the winners."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.operators import policy, trees
from larder.plans import replenish
from larder.plans.selection import Settings

FIRST = dt.date(2024, 1, 1)


@pytest.fixture(scope="module")
def clean(spark):
    rng = np.random.default_rng(5)
    data = [(s, FIRST + dt.timedelta(days=i), float(rng.integers(5, 40)), float(rng.integers(0, 30)), float(rng.integers(0, 9)))
            for s in ("a", "b") for i in range(60)]
    return spark.createDataFrame(data, "series_id string, date date, demand_model double, stock_1day_left double, stock_2day_left double")


def plain(table, chosen, scenario):
    """Orders of one series, day by day."""
    demand = {r.date: r.demand_model for r in table}
    stock = {r.date: r.stock_1day_left + r.stock_2day_left for r in table}
    mean = np.mean(list(demand.values()))
    days = sorted(chosen)
    h = scenario.horizon
    errors = [sum(demand[days[i + k]] for k in range(1, h + 1)) - h * chosen[days[i]]
              for i in range(len(days) - h) if chosen[days[i]] is not None]
    safety = scenario.z * np.std(errors) if errors else None
    out = {}
    for d in days:
        if chosen[d] is None or safety is None:
            out[d] = None
            continue
        level = min(h * chosen[d] + safety, scenario.cover_cap * mean)
        out[d] = max(0.0, float(np.round(level - stock[d])))
    return out


def test_orders_follow_the_chosen_forecast(spark, clean):
    def forecast(s, i):
        return None if (s, i) == ("a", 45) else float(12 + (7 * i) % 13)
    # the block is the last 20 days of a, the last 3 of b: too short for an interval error
    rows = [(s, FIRST + dt.timedelta(days=i), "m", forecast(s, i)) for s, n in (("a", 20), ("b", 3)) for i in range(60 - n, 60)]
    chosen = spark.createDataFrame(rows, "series_id string, date date, model string, forecast double")
    scenario = policy.Scenario(service_level=0.9)
    got = policy.order_days(policy.chosen_forecast(clean, chosen), policy.stock_position(clean), scenario).collect()
    assert len(got) == 23
    for s in ("a", "b"):
        table = clean.filter(F.col("series_id") == s).collect()
        want = plain(table, {d: f for x, d, _, f in rows if x == s}, scenario)
        assert {r.date: r.order_qty for r in got if r.series_id == s} == want
    assert all(r.order_qty is None and r.position is not None for r in got if r.series_id == "b")


def test_each_winner_is_explained_by_its_own_kind_of_model(spark, features):
    small = Settings(n_alphas=2, gbt=trees.GBT)
    names = sorted(r.series_id for r in features.select("series_id").distinct().collect())
    kinds = ["gbt", "theta", "avg_trimmed"]
    winners = spark.createDataFrame([(n, kinds[i % 3]) for i, n in enumerate(names)], "series_id string, winner string")
    found = replenish.explain_winners(features, winners, small).collect()
    by = {(r.series_id, r.winner): r.explained_by for r in found}
    assert by == {(n, kinds[i % 3]): "gbt" if i % 3 == 0 else "elasticnet" for i, n in enumerate(names)}
    shares = [r.value for r in found if r.series_id == names[0]]
    assert min(shares) >= 0 and abs(sum(shares) - 1) < 1e-6
    assert replenish.explain_winners(features, winners.limit(0), small).count() == 0
