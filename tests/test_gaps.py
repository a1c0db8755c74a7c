"""Days far from the rest, distinct counts, gaps and repeated days in a stream."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from larder.operators import rows
from larder.plans import cleaning
from larder.session import new_path
from larder.sources import daily
from larder.streaming import feed, stateful

DAY = dt.timedelta(days=1)
FIRST = dt.date(2024, 1, 1)


def days(spark, dates, series_id="a"):
    return spark.createDataFrame([(series_id, d, 1.0) for d in dates], "series_id string, date date, x double")


def test_a_stray_year_costs_one_reject(spark):
    df = days(spark, [FIRST, FIRST + 2 * DAY, dt.date(9999, 12, 31), dt.date(1066, 10, 14)])
    complete = rows.calendar_complete(df).orderBy("date").collect()
    assert [(r.date, r.x, r.is_inserted) for r in complete] == [(FIRST, 1.0, 0), (FIRST + DAY, None, 1), (FIRST + 2 * DAY, 1.0, 0)]
    rejected = {(r.span, r.first_day, r.n_days) for r in rows.rejected_spans(df).collect()}
    assert rejected == {(0, dt.date(1066, 10, 14), 1), (2, dt.date(9999, 12, 31), 1)}


@pytest.mark.parametrize("gap, kept", [(3, 4), (2, 2)])
def test_spans_split_above_the_limit_and_the_first_of_equals_stays(spark, gap, kept):
    df = days(spark, [FIRST, FIRST + DAY, FIRST + 4 * DAY, FIRST + 5 * DAY])
    near = rows.with_span(df, gap).filter("is_near").orderBy("date").collect()
    assert len(near) == kept and near[0].date == FIRST


def test_spans_of_no_rows_and_of_series_apart(spark):
    assert rows.rejected_spans(days(spark, [])).count() == 0
    assert rows.calendar_complete(days(spark, [])).count() == 0
    both = days(spark, [FIRST], "a").unionByName(days(spark, [dt.date(1066, 1, 1)], "b"))
    assert rows.rejected_spans(both).count() == 0  # far apart, but each the only span of its series


def test_the_report_counts_rows_of_far_days(spark):
    raw = days(spark, [FIRST, FIRST, FIRST + DAY, dt.date(9999, 1, 1), dt.date(9999, 1, 1)])
    marked = cleaning.clean_marked(raw.withColumn("units_used", F.lit(3.0)).withColumn("units_requested", F.lit(4.0)))
    report = cleaning.cleaning_report(marked, diagnose=False).first()
    assert (report.rows_rejected_far_day, report.duplicate_dates_removed, marked.count()) == (2, 1, 2)


def test_distinct_counts_equal_the_plain_ones(spark):
    data = [("a", FIRST, 1, 2.0), ("a", FIRST, 1, None), ("a", FIRST, None, 2.0), ("a", None, 7, 1.0), (None, FIRST, 3, 1.0),
            (None, FIRST, 4, 1.0), ("b", FIRST, None, None)]
    df = spark.createDataFrame(data, "s string, d date, k int, v double")
    ours = daily.roll_up(df, F.col("s"), F.col("d"), {"total": F.sum("v"), "n": F.count(F.lit(1))},
                         {"kinds": F.col("k"), "values": F.col("v")})
    plain = df.groupBy(F.col("s").alias("series_id"), F.col("d").alias("date")).agg(
        F.sum("v").alias("total"), F.count(F.lit(1)).alias("n"), F.countDistinct("k").cast("double").alias("kinds"),
        F.countDistinct("v").cast("double").alias("values"))
    assert ours.columns == plain.columns
    assert sorted(map(repr, ours.collect())) == sorted(map(repr, plain.collect()))
    assert "Expand" not in ours._jdf.queryExecution().executedPlan().toString()


def as_stream(spark, batches):
    """A feed of one file a batch, in this order, and its end."""
    path = new_path(spark, "feed")
    table = None
    for batch in batches:
        table = spark.createDataFrame(batch, "series_id string, date date, y double").coalesce(1)
        table.write.mode("append").parquet(path)
    return feed.closing_feed(feed.read_files(spark, table, path, files_per_batch=1), "date")


def test_a_stream_with_gaps_equals_the_batch(spark):
    dates = [FIRST + i * DAY for i in range(30)]
    value = {d: float(i * i % 11) for i, d in enumerate(dates)}
    present = [d for i, d in enumerate(dates) if i not in (3, 4, 11, 20, 21, 22)]
    batches = [[("a", d, value[d]) for d in present[i:i + 8]] for i in range(0, len(present), 8)]
    # repeated days with other values: greater, less and missing; before and after the row they repeat
    batches[0] = [("a", present[1], value[present[1]] + 4), *batches[0], ("a", present[2], -1.0)]
    batches[1] = [*batches[1], ("a", present[12], None)]
    stream, closing = as_stream(spark, batches)
    got = {r.date: (r.forecast, r.actual) for r in feed.run_to_end(stateful.seasonal_naive(stream), "gaps", closing).collect()}
    everything = spark.createDataFrame([r for b in batches for r in b], "series_id string, date date, y double")
    batch = rows.calendar_complete(rows.dedup_daily(everything)).toPandas().set_index("date")["y"]
    batch = {d: None if v != v else v for d, v in batch.items()}
    assert got == {d: (batch.get(d - 7 * DAY), v) for d, v in batch.items()}
    assert batch[present[2]] == -1.0 and batch[present[12]] is None


def test_smoothing_keeps_its_weights_over_a_gap(spark):
    dates = [FIRST + i * DAY for i in range(35)]
    data = [("a", d, 10.0 + i % 7) for i, d in enumerate(dates) if i not in (25, 26)]
    weights = spark.createDataFrame([("a", dates[14], dates[-1] + DAY, 0.3, 0.05, 0.2)],
                                    "series_id string, valid_from date, valid_to date, alpha double, beta double, gamma double")
    stream, closing = as_stream(spark, [data])
    out = feed.run_to_end(stateful.holt_winters(stream, weights), "smooth", closing, one_batch=True).orderBy("date").collect()
    assert [r.date for r in out] == dates[14:]
    assert [r.actual for r in out[11:13]] == [None, None] and all(r.forecast is not None for r in out)
    # a day without a row is learnt as its own forecast: a steady week stays what it was
    assert all(abs(r.forecast - (10 + i % 7)) < 1e-6 for i, r in zip(range(14, 35), out))


def test_a_gap_beyond_the_limit_is_not_filled(spark):
    later = FIRST + (rows.MAX_GAP + 1) * DAY
    stream, closing = as_stream(spark, [[("a", FIRST, 1.0), ("a", later, 2.0)]])
    out = feed.run_to_end(stateful.seasonal_naive(stream), "far", closing, one_batch=True).collect()
    assert sorted(r.date for r in out) == [FIRST, later]
