"""Ledger invariants and streams against batch."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from larder.operators import ledger, policy, smoothing, splits
from larder.operators.policy import Scenario
from larder.streaming import feed, stateful
from registry.common import policy_input
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def daily(spark):
    from larder.session import stored
    return stored(policy_input(spark, SMALL), "policy")


@pytest.fixture(scope="module")
def book(daily):
    from larder.session import stored
    return stored(ledger.stock_ledger(daily, policy.mix_scenarios((0.0, 0.05, 0.3))), "book")


def test_units_are_conserved(daily, book):
    inflow = F.col("arrived_short") + F.col("arrived_long") + F.col("courier")
    outflow = F.col("served") + F.col("expired_short") + F.col("expired_long")
    stock = F.col("onhand_short") + F.col("onhand_long")
    from pyspark.sql import Window
    w = Window.partitionBy("series_id", "scenario").orderBy("t")
    off = book.withColumn("gap", stock - F.lag(stock).over(w) - inflow + outflow).filter("abs(gap) > 0")
    assert off.isEmpty()
    assert book.count() == 3 * daily.count()


def test_floor_holds_and_all_demand_is_met(book):
    assert book.filter((F.col("onhand_short") + F.col("onhand_long") < 10) | (F.col("short") > 0)).isEmpty()


def test_without_long_life_units_there_is_one_pool(book):
    assert book.filter("scenario = 'long_0.00' AND onhand_long + arrived_long + expired_long <> 0").isEmpty()


def test_ledger_does_not_depend_on_neighbours(daily, book):
    alone = ledger.stock_ledger(daily.filter("series_id = 'NF'"), policy.mix_scenarios((0.3,)))
    together = book.filter("series_id = 'NF' AND scenario = 'long_0.30'")
    assert alone.exceptAll(together).isEmpty() and alone.count() == together.count()


def walk(demand, forecast, mean, sigma, s):
    """One series, one unit list per pool, day by day."""
    short, long_ = [0] * s.shelf_life, [0] * s.shelf_life_long
    seed = round(mean)
    es, el = max(s.shelf_life - s.lead_time - 1, 0), max(s.shelf_life_long - s.lead_time - 1, 0)
    long_[el] += round(seed * s.frac_long)
    short[es] += seed - round(seed * s.frac_long)
    coming = [seed] * s.lead_time
    out = []
    for d, f in zip(demand, forecast):
        gone = short.pop(0) + long_.pop(0)
        short.append(0)
        long_.append(0)
        come = coming.pop(0)
        long_[el] += round(come * s.frac_long)
        short[es] += come - round(come * s.frac_long)
        target = min(s.horizon * f + s.z * sigma, s.cover_cap * mean)
        order = max(0, round(target - sum(short) - sum(long_) - sum(coming)))
        coming.append(order)
        extra = max(0, s.safety_floor + round(d) - sum(short) - sum(long_))
        short[es] += extra
        need = round(d)
        for left in range(max(len(short), len(long_))):
            for pool in (short, long_):
                if left < len(pool):
                    take = min(pool[left], need)
                    pool[left] -= take
                    need -= take
        out.append((order, extra, gone, sum(short), sum(long_)))
    return out


@pytest.mark.parametrize("s", [Scenario(), Scenario("x", 0.98, 0.25, lead_time=1, review=2, shelf_life=3,
                                                    shelf_life_long=4, safety_floor=0),
                               Scenario("y", 0.9, 0.5, lead_time=4, shelf_life=4, shelf_life_long=9)])
def test_ledger_against_a_unit_by_unit_walk(spark, s):
    rng = np.random.default_rng(5)
    demand, forecast = rng.integers(0, 80, 120).astype(float), rng.uniform(10, 60, 120)
    mean = float(demand.mean())
    pdf = pd.DataFrame({"series_id": "a", "date": pd.date_range("2024-01-01", periods=120).date, "demand": demand,
                        "forecast": forecast, "mean_daily": mean, "sigma_interval": 21.3})
    table = spark.createDataFrame(pdf, "series_id string, date date, demand double, forecast double, "
                                       "mean_daily double, sigma_interval double")
    got = ledger.stock_ledger(table, [s]).orderBy("t").collect()
    assert [(r.ordered, r.courier, r.expired_short + r.expired_long, r.onhand_short, r.onhand_long) for r in got] == \
        walk(demand, forecast, mean, 21.3, s)


def test_issue_order():
    assert policy.issue_order(2, 3) == [("short", 1), ("long", 1), ("short", 2), ("long", 2), ("long", 3)]
    with pytest.raises(ValueError):
        Scenario(lead_time=0)


def test_smoothing_stream_equals_fixed_weights(spark, features):
    """With one version of the weights the stream repeats the batch recursion, in batches of any size."""
    from larder.session import new_path
    days = features.select("series_id", "date", "y")
    weights = features.groupBy("series_id").agg(F.min("date").alias("valid_from"), F.max("date").alias("m")).select(
        "series_id", F.lit(0).alias("version"), "valid_from", F.date_add("m", 1).alias("valid_to"),
        F.lit(0.3).alias("alpha"), F.lit(0.05).alias("beta"), F.lit(0.2).alias("gamma"))
    first, last = days.agg(F.min("date"), F.max("date")).first()
    third = (last - first) / 3
    path = new_path(spark, "feed")
    for k in range(3):  # three parts in day order, each with its series in any order
        lo, hi = first + third * k, (first + third * (k + 1) if k < 2 else last)
        part = days.filter((F.col("date") > lo if k else F.col("date") >= lo) & (F.col("date") <= hi))
        part.orderBy(F.rand(k)).coalesce(1).write.mode("append").parquet(path)
    stream, closing = feed.closing_feed(feed.read_files(spark, days, path, files_per_batch=1), "date")
    out = feed.run_to_end(stateful.holt_winters(stream, weights, delay="2 days"), "hw", closing)
    batch = smoothing.holt_winters_fixed(features, 0.3, 0.05, 0.2)
    both = out.join(batch.select("series_id", "date", F.col("forecast").alias("b")), ["series_id", "date"])
    starts = days.groupBy("series_id").agg(F.min("date").alias("first"))
    due = days.join(starts, "series_id").filter(F.col("date") >= F.date_add("first", 14))
    assert out.count() == both.count() == due.count() > 10000
    assert both.filter(F.abs(F.col("forecast") - F.col("b")) > 1e-6).isEmpty()


def test_weight_versions_cover_the_test_block(features):
    split = splits.usable(splits.backtest_window(features))
    versions = smoothing.holt_winters_weights(features, split, 28).collect()
    assert len(versions) == 6 * 6
    assert sum((v.valid_to - v.valid_from).days for v in versions) == 6 * 168


def test_report_sink_reads_back_whole(spark, book):
    from larder.session import new_path
    from larder.sources.sink import write_report
    for buckets in (0, 4):
        back = write_report(book, new_path(spark, "sink"), buckets=buckets)
        assert back.select(book.columns).exceptAll(book).isEmpty() and back.count() == book.count()


def test_stream_does_not_depend_on_how_a_backlog_is_filed(spark, daily):
    """Everything in one batch, from files that each hold all days of some series."""
    from larder.session import new_path
    sigma = policy.interval_error_std(daily, 3)
    table = daily.join(sigma, "series_id")
    path = new_path(spark, "feed")
    table.repartition(5, "series_id").write.parquet(path)
    stream, closing = feed.closing_feed(feed.read_files(spark, table, path), "date")
    out = feed.run_to_end(stateful.stock_ledger(stream), "ledger", closing)
    want = ledger.stock_ledger(table, [Scenario()]).select(out.columns)
    assert out.count() == want.count() and out.exceptAll(want).isEmpty()
