"""Session helpers: a local session for tests, and the shared folder for cut lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = 8, name: str = "larder", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus if str(cpus).isdigit() else 8))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="larder-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that nothing else uses."""
    return os.path.join(shared_folder(spark), f"larder-{label}-{uuid.uuid4().hex}")


_WRITTEN: list[str] = []
_TABLES: list[str] = []


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Delete every table that ``stored`` wrote; for the end of a job, when no result reads them any more."""
    while _TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {_TABLES.pop()}")
    while _WRITTEN:
        _delete(spark, _WRITTEN.pop())


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Used before a table feeds many model fits: the lineage is cut, the columns
    stay prunable, and losing an executor costs a re-read rather than a recompute.
    """
    path = new_path(df.sparkSession, label)
    _WRITTEN.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def wide(spark: SparkSession) -> int:
    """At least one partition per core, and as many as an exchange makes."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


# Keys that a partition of an exchange on them holds at least, beyond two partitions a core.
KEYS_A_PART = 16


def parts(df: DataFrame, *keys: str) -> int:
    """Partitions for an exchange on ``keys``: two a core, more only as there are more keys, at most ``wide``.

    A key is never divided, so a number that follows the session's setting alone makes empty tasks, each with a start, a scan and a
    result for the driver, in every job that reads them.  A power of two beyond two a core, so that tables of nearly the same
    keys get the same number.
    """
    least, most = 2 * df.sparkSession.sparkContext.defaultParallelism, wide(df.sparkSession)
    if least >= most:
        return most
    full = df.select(*keys).distinct().count() // KEYS_A_PART
    return min(most, max(least, 1 << full.bit_length()))


def stored_by(df: DataFrame, label: str, key: str = "series_id", order: tuple[str, ...] = ("date",)) -> DataFrame:
    """``stored`` in buckets of ``key``, one file each: windows, aggregates and joins on ``key`` read it without an exchange.

    Tables written in one session have equal buckets, so they join where they lie.  A bucket holds whole keys: for
    keys whose rows are bounded, as the days of a series are.  Rows are sorted by the key and those of ``order`` that exist.
    Where the session's exchanges are wider than two a core, rows are written once before they are dealt out, so that their keys
    can be counted (``parts``) without making them twice.
    """
    spark = df.sparkSession
    path, first = new_path(spark, label), None
    if 2 * spark.sparkContext.defaultParallelism < wide(spark):
        df = stored(df, label)
        first = _WRITTEN.pop()
    buckets = parts(df, key)
    name = os.path.basename(path).replace("-", "_")
    _WRITTEN.append(path)
    _TABLES.append(name)
    sort = [key, *(c for c in order if c in df.columns)]
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(*sort).option("path", path).saveAsTable(name)
    if first:
        _delete(spark, first)
    return spark.table(name)


def spread(df: DataFrame, *keys: str, keyed: DataFrame | None = None) -> DataFrame:
    """Exchange on ``keys`` into a fixed number of partitions (``parts``).

    For work whose cost is CPU rather than bytes: the adaptive planner would
    otherwise merge small partitions and run the fits one after another.
    ``keyed`` is a table with the same keys that is cheaper to count than ``df``.
    """
    return df.repartition(parts(df if keyed is None else keyed, *keys), *keys)
