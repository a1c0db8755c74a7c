"""Write results so that later reads can skip what they do not need."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_report(df: DataFrame, path: str, buckets: int = 0, mode: str = "errorifexists") -> DataFrame:
    """Write a result table clustered by series and return it as read back.

    Rows are range-clustered on ``series_id`` so the parquet statistics prune a
    lookup of one series.  ``buckets`` > 0 adds a ``series_bucket`` folder level;
    a folder per series would mean one tiny file for each of millions of series.
    """
    order = [c for c in ("series_id", "date") if c in df.columns]
    if buckets:
        df = df.withColumn("series_bucket", F.pmod(F.xxhash64("series_id"), F.lit(buckets)).cast("int"))
        clustered = df.repartitionByRange("series_bucket", *order).sortWithinPartitions("series_bucket", *order)
        clustered.write.mode(mode).partitionBy("series_bucket").parquet(path)
    else:
        clustered = df.repartitionByRange(*order).sortWithinPartitions(*order)
        clustered.write.mode(mode).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
