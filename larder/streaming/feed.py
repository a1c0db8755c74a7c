"""Transactions to daily rows, and running a stream to the end of what is there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.session import new_path


def daily_demand(transactions: DataFrame, series_id: Column, measures: dict[str, Column],
                 time: str = "ts", delay: str = "2 days") -> DataFrame:
    """One row per series and day, emitted once when the watermark has passed the day.

    State is one partial aggregate per open day and series; rows later than
    ``delay`` are dropped by the watermark.
    """
    kind = dict(transactions.dtypes)[time]
    # Days are UTC days, whatever the session's time zone.
    instant = F.expr(
        f"make_timestamp_ltz(year({time}), month({time}), day({time}), hour({time}), minute({time}), "
        f"extract(SECOND FROM {time}), 'UTC')") if kind == "timestamp_ntz" else F.col(time)
    keyed = transactions.withColumns({"series_id": series_id, "_at": instant}).withWatermark("_at", delay)
    rolled = keyed.groupBy(F.window("_at", "1 day"), "series_id").agg(*[c.alias(n) for n, c in measures.items()])
    day = F.date_from_unix_date((F.unix_seconds("window.start") / 86400).cast("int"))
    return rolled.select("series_id", day.alias("date"), *measures)


#: Time of the marker that closes a stream: later than any row, so that the watermark passes every day, and still in
#: the range of the nanosecond times that Python workers use.
END = "2260-01-01"


def run_to_end(stream: DataFrame, label: str, closing: tuple[DataFrame, str] | None = None, one_batch: bool = False) -> DataFrame:
    """Process all available input into files under the shared folder and return them as a table.

    Without ``closing`` the last days stay in the state, as a watermark waits for late rows.  With it the
    input has ended: after all of it a marker (see ``closing_feed``) moves the watermark past every day, in a
    second run from the same checkpoint.  If all input is one batch (``one_batch``; files are read without
    ``files_per_batch``), the marker joins it: no row of a batch is late for the batch's own marker, and the run closes
    the days in the batch without data that follows it.
    """
    spark: SparkSession = stream.sparkSession
    out, progress = new_path(spark, label), new_path(spark, f"{label}-progress")

    def close():
        marker, folder = closing
        marker.write.mode("append").parquet(folder)

    if closing is not None and one_batch:
        close()
    for last in (False, True) if closing is not None and not one_batch else (False,):
        if last:
            close()
        query = (stream.writeStream.format("parquet").outputMode("append")
                 .option("path", out).option("checkpointLocation", progress).trigger(availableNow=True).start())
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def read_files(spark: SparkSession, table: DataFrame, folder: str, files_per_batch: int = 0,
               pattern: str | None = None) -> DataFrame:
    """A stream over the parquet files of a folder, with the schema of ``table``.

    Files are taken in the order they were written.  With ``files_per_batch`` a
    backlog has to be written in day order, part after part: rows of a later file
    that lie behind the watermark are late.
    """
    reader = spark.readStream.schema(table.schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(folder)


def closing_feed(stream: DataFrame, time: str) -> tuple[DataFrame, tuple[DataFrame, str]]:
    """``stream`` with a second feed for its end, and what ``run_to_end`` writes there: one row, all null but ``time``.

    The marker has no series, so it only moves the watermark; its own day never passes.
    """
    spark, schema = stream.sparkSession, stream.schema
    folder = new_path(spark, "closing")
    kinds = {f.name: f.dataType for f in schema}
    marker = spark.range(1).select(*[(F.lit(END) if c == time else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])
    marker.limit(0).write.parquet(folder)
    return stream.unionByName(spark.readStream.schema(marker.schema).parquet(folder)), (marker, folder)
