"""Row and value repairs on small hand-made tables."""

import datetime as dt

import pandas as pd
import pytest
from pandas.tseries.holiday import USFederalHolidayCalendar
from pyspark.sql import functions as F

from larder import schema
from larder.operators import calendar, checks, rows, values
from larder.plans import cleaning
from tests.conftest import series


def column(df, name, key="series_id"):
    return [r[name] for r in df.orderBy(key, "date").collect()]


def test_holidays_match_the_public_calendar(spark):
    ours = {r.date for r in calendar.holiday_table(spark, "1970-01-01", "2040-12-31").collect()}
    theirs = {d.date() for d in USFederalHolidayCalendar().holidays("1970-01-01", "2040-12-31")}
    assert ours == theirs


def test_gap_fill_stops_at_the_limit(spark):
    df = series(spark, [None, 4, None, None, 7, None, None, None, 9, None], column="x")
    carried = column(values.fill_short_gaps(df, ["x"], []), "x")
    assert carried == [None, 4, 4, 4, 7, None, None, None, 9, 9]
    linear = values.fill_short_gaps(df, [], ["x"])
    assert column(linear, "x") == [4, 4, 5, 6, 7, None, None, None, 9, 9]
    assert column(linear, "row_was_imputed") == [1, 0, 1, 1, 0, 0, 0, 0, 0, 1]
    past = values.fill_short_gaps(df, [], ["x"], past_only=True)
    assert column(past, "x") == [None, 4, 4, 4, 7, None, None, None, 9, 9]


def test_gap_fill_of_a_series_without_values(spark):
    for n in (1, 2, 3):
        out = values.fill_short_gaps(series(spark, [None] * n, column="x"), [], ["x"])
        assert column(out, "x") == [None] * n
        assert column(out, "row_was_imputed") == [0] * n


@pytest.mark.parametrize("limit", [1, 3])
def test_gap_fill_against_pandas(spark, limit):
    import numpy as np
    rng = np.random.default_rng(7)
    raw = pd.Series(rng.integers(0, 50, 300).astype(float)).mask(rng.random(300) < 0.45)
    out = values.fill_short_gaps(series(spark, [None if pd.isna(v) else v for v in raw], column="x"), [], ["x"], limit)
    miss = raw.isna()
    run = miss.groupby((miss != miss.shift()).cumsum()).transform("sum")
    want = raw.mask(miss & (run <= limit), raw.interpolate(limit_direction="both").round())
    assert [None if pd.isna(v) else v for v in want] == column(out, "x")


def test_dedup_keeps_the_first_copy_and_counts_conflicts(spark):
    raw = spark.createDataFrame(
        [("a", "2024-01-01", "5", 2), ("a", "2024-01-01", "4", 1), ("a", "2024-01-03", "7", 1),
         ("a", "2024-01-03", "7", 2), ("a", "nonsense", "1", 1)],
        "series_id string, date string, units_used string, seq int")
    days = rows.rows_by_day(rows.parse_dates(raw), "seq")
    counts = rows.row_counters(days).collect()[0]
    assert (counts.rows_dropped_bad_date, counts.conflicting_duplicate_dates, counts.duplicate_dates_removed) == (1, 1, 2)
    assert column(rows.dedup_daily(rows.parse_dates(raw), "seq"), "units_used") == ["4", "7"]
    clean = cleaning.clean_daily(raw, sequence="seq")
    assert column(clean, "units_used") == [4.0, 4.0, 7.0]
    assert column(clean, "date") == [dt.date(2024, 1, d) for d in (1, 2, 3)]


def test_result_does_not_depend_on_order_or_partitions(spark):
    from registry.common import DIRTY, dirty
    from tests.conftest import SMALL
    raw = dirty(spark, SMALL)
    one = cleaning.clean_daily(raw.orderBy(F.rand(3)).repartition(3), **DIRTY)
    two = cleaning.clean_daily(raw.coalesce(1), **DIRTY)
    assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


def test_copies_of_a_series_under_other_keys_agree(spark):
    one = series(spark, [3, 5, None, 8, 2, 9, 4, 4, 50, 1], column="units_used")
    both = one.unionByName(one.withColumn("series_id", F.lit("b")))
    clean = cleaning.clean_daily(both)
    a, b = (clean.filter(F.col("series_id") == k).drop("series_id") for k in "ab")
    assert a.exceptAll(b).isEmpty()


def test_decensored_demand_needs_both_values(spark):
    df = spark.createDataFrame([("a", 3.0, 5.0), ("a", None, 5.0), ("a", 6.0, 5.0)],
                               "series_id string, units_used double, units_requested double")
    assert [(r.is_shortage, r.demand_model) for r in checks.decensor_demand(df).collect()] == [
        (1, 5.0), (0, None), (0, 6.0)]


def test_stock_columns_follow_the_shelf_life():
    assert len(schema.schema_columns(5)) == 20 and len(schema.schema_columns(7)) == 22
    found = schema.stock_columns_in(["stock_10day_left", "x", "stock_2day_left"])
    assert found == ["stock_2day_left", "stock_10day_left"]
    assert schema.roles_for(["stock_7day_left"])["stock_7day_left"] == schema.STOCK
