"""Helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larder.session import stored  # noqa: F401  (re-exported for the operators)

#: A word: a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def words(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text; ``bytes.split`` cuts at exactly the six white-space bytes of WORD."""
    return text.split()


def uniform(*columns, seed: int) -> Column:
    """A number in (0, 1) that follows from the columns and the seed alone, so that reruns agree."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def row_keys(*columns: str) -> list[Column]:
    """Two 64-bit keys ``k1, k2`` of a row by the named columns; never null, equal for equal rows."""
    return [F.xxhash64(F.lit(n), *(F.col(c) for c in columns), F.lit(n)).alias(f"k{n}") for n in (1, 2)]


def matching_rows(docs: DataFrame, kept: DataFrame, *columns: str) -> DataFrame:
    """One row of ``docs`` for each pair of keys in ``kept``; the rows travel once."""
    names = [f"__{i}" for i in range(len(docs.columns))]
    renamed = docs.toDF(*names)
    mine = [names[docs.columns.index(c)] for c in columns]
    joined = renamed.withColumns(dict(zip(("__k1", "__k2"), row_keys(*mine), strict=True))).join(
        kept.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")), ["__k1", "__k2"], "left_semi")
    one = joined.withColumn("__n", F.row_number().over(W.partitionBy("__k1", "__k2").orderBy("__k1")))
    return one.filter("__n = 1").select(*names).toDF(*docs.columns)


def lean(spark: SparkSession) -> None:
    """Lets at most 1,000 rows travel to Python at once, as texts are long; the session keeps the setting, a lower one stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= 1000:
        spark.conf.set(name, "1000")


def give_back() -> None:
    """Returns what a finished task no longer needs to the machine.  Python workers serve later stages, and free memory would stay theirs."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim:
        trim(0)


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def partitions_for(rows: int, per_task: int, spark: SparkSession) -> int:
    """Enough partitions for so many rows a task, and one per core at least."""
    return max(-(-rows // per_task), spark.sparkContext.defaultParallelism, 1)


def consecutive(batches: Iterator, key: str) -> Iterator:
    """Whole groups from batches sorted by ``key``: (key, pandas frame), one group held at a time."""
    import pandas as pd

    held, current = [], None
    for pdf in batches:
        if pdf.empty:
            continue
        values = pdf[key].to_numpy()
        cuts = [0, *((values[1:] != values[:-1]).nonzero()[0] + 1), len(pdf)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            piece = pdf.iloc[a:b]
            if held and current != values[a]:
                yield current, held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
                held = []
            current = values[a]
            held.append(piece)
    if held:
        yield current, held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
