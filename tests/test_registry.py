"""Registered queries against their SQL, on the small data, where long gaps occur."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL

# A cross-section that keeps the suite short; tools/compare.py runs all of them.
CHECKED = [
    "daily_source", "conflicting_dates", "dup_removed", "dedup_daily", "calendar_complete", "negatives_to_null",
    "null_run_length", "interpolate_short", "clean_dirty_daily", "cleaning_report", "federal_holidays",
    "seasonal_trend_strength", "build_features", "scale_train", "rolling_origin", "backtest_rejects",
    "score_table", "avg_trimmed", "winner_on_validation", "order_up_to", "order_on_winner", "calendar_rejects", "stream_forecast_gaps", "expiry_first_issue", "stock_ledger", "mix_sweep",
    "policy_comparison", "top_drivers", "fc_holt_winters", "stream_daily_demand", "stream_stock_ledger",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        return None if isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=lambda t: tuple(map(repr, t)))


@pytest.mark.parametrize("name", CHECKED)
def test_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SMALL)
    cur = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    got, want = rows(df.columns, df.collect()), rows(names, cur.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and x == pytest.approx(y, abs=2e-6))
                   for x, y in zip(a, b)), (a, b)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 6
