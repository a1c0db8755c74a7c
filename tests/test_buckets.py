import pytest
from pyspark.sql import functions as F

from larder import session
from larder.operators import naive, scoring, splits
from registry import data, stock
from registry.stock import REGISTRY, naive_forecasts
from tests.conftest import SMALL


@pytest.fixture
def no_broadcast(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_rows_and_types_stay(spark, features):
    again = session.stored_by(features.repartition(3), "again")
    assert again.dtypes == features.dtypes
    assert again.exceptAll(features).count() == 0 and again.count() == features.count()
    assert session.stored_by(features.limit(0), "empty").count() == 0


def test_a_series_lies_in_one_bucket(spark, features):
    files = features.select("series_id", F.input_file_name().alias("file")).distinct()
    assert files.groupBy("series_id").count().filter("count > 1").count() == 0


@pytest.mark.parametrize("query", [data.rolling_origin, data.backtest_window, stock.fc_seasonal_naive, stock.mase_scale])
def test_queries_on_series_need_no_exchange(spark, no_broadcast, query):
    query(spark, SMALL)  # the stored table is made on first use
    assert exchanges(query(spark, SMALL)) == 0


def test_selection_reads_rows_where_they_lie(spark, no_broadcast, features):
    blocks = splits.pct_split(features)
    long = naive_forecasts(features)
    split = splits.validation_split(blocks)
    forecasts = naive.in_test_block(long, split).select(*naive.LONG)
    scale = scoring.mase_scale(features, split)
    assert exchanges(scoring.on_common_days(forecasts)) == 0
    assert exchanges(scoring.score(forecasts, scale)) == 0
    _, scores, members = scoring.with_ensemble(forecasts, scale)
    assert exchanges(members) == 0
    assert exchanges(scores) == 0
    winners = scoring.winner(scores, REGISTRY)
    assert exchanges(winners) <= 2  # of scores, a row for each series and model
    assert exchanges(stock.winner_on_validation(spark, SMALL)) <= 4


@pytest.fixture
def many_partitions(spark):
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, "300")
    yield
    spark.conf.set(name, before)


def test_few_series_make_few_tasks_whatever_the_setting(spark, features, many_partitions, monkeypatch):
    for name in ("_WRITTEN", "_TABLES"):
        monkeypatch.setattr(session, name, [])
    most = 2 * spark.sparkContext.defaultParallelism
    again = session.stored_by(features, "again")
    buckets = spark.sql(f"DESCRIBE EXTENDED {session._TABLES[0]}").filter("col_name = 'Num Buckets'").first()["data_type"]
    assert int(buckets) <= most
    assert session.spread(features, "series_id").rdd.getNumPartitions() <= most
    assert again.exceptAll(features).count() == 0 and again.count() == features.count()
    # the rows written to be counted are gone; only the table is left to release
    assert len(session._WRITTEN) == 1
    session.release(spark)


def test_partitions_grow_with_the_keys(spark, many_partitions):
    keys = spark.range(40 * session.KEYS_A_PART).select(F.col("id").cast("string").alias("series_id"))
    assert session.parts(keys, "series_id") == 64
    assert session.parts(keys.limit(0), "series_id") == 2 * spark.sparkContext.defaultParallelism
    many = spark.range(10_000 * session.KEYS_A_PART).select(F.col("id").cast("string").alias("series_id"))
    assert session.parts(many, "series_id") == 300


def test_release_drops_the_tables(spark, monkeypatch):
    for name in ("_WRITTEN", "_TABLES"):
        monkeypatch.setattr(session, name, [])
    session.stored_by(spark.range(3).withColumnRenamed("id", "series_id"), "short")
    name = session._TABLES[0]
    assert spark.catalog.tableExists(name)
    session.release(spark)
    assert not spark.catalog.tableExists(name) and session._TABLES == []
