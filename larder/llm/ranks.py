"""Gapless positions within groups of any size, without a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larder.llm.common import stored

#: ``monotonically_increasing_id`` counts the rows of a partition in its lower bits.
_ROW_BITS = 33


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos`` (from 0, by ``order`` ascending with nulls first, within ``group``) and ``total``, the group's rows.

    Rows are exchanged once, by ranges of (group, order), so a group may span any number of tasks; each range counts its rows by
    group, and the sums of what lies before it are joined to it.  Rows that agree in all of ``order`` take any of their positions.
    Null is a group like others.  The ranges are written to the shared folder: a lost executor costs a re-read.
    """
    in_order = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    held = stored(in_order.withColumn("__row", F.monotonically_increasing_id()), "ranges")
    pieces = held.groupBy(F.col(group).alias("__g"), F.shiftright("__row", _ROW_BITS).alias("__p")).agg(
        F.min("__row").alias("__first"), F.count("*").alias("__n"))
    of_group = W.partitionBy("__g")  # a row for each range that the group spans
    before = of_group.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    starts = pieces.withColumns({"__start": F.coalesce(F.sum("__n").over(before), F.lit(0)), "total": F.sum("__n").over(of_group)})
    joined = held.withColumn("__q", F.shiftright("__row", _ROW_BITS)).join(
        starts.drop("__n"), F.col(group).eqNullSafe(F.col("__g")) & (F.col("__q") == F.col("__p")))
    return joined.withColumn("pos", F.col("__row") - F.col("__first") + F.col("__start")).drop("__row", "__g", "__p", "__q", "__first", "__start")
