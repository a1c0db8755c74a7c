"""Quality by importance resampling of hashed n-gram models.

Two generative models, bags of hashed words and word pairs, are counted: one of the target (documents labelled good)
and one of the raw corpus (all documents).  A document's importance is the log of its likelihood under the first over that under the
second.  Documents are then sampled without replacement by Gumbel top-k: log importance plus a Gumbel number, of
which the ``k`` highest stay.  This is resampling in proportion to importance, not a cut by score.

The models are sums over tasks of ``BUCKETS`` numbers each.  The target uses a bounded sample of labelled
rows (``MAX_ROWS``), the raw counts every word of every document.  The k-th highest key is found by counting keys in
ever narrower ranges, so nothing is sorted as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import lean, stored, uniform

BUCKETS = 1 << 14
#: Labelled rows that the target model is counted on: those least by a hash of their id.
MAX_ROWS = 20_000
#: Ranges of one count, and keys that are compared one by one in the end.
RANGES, FEW = 1024, 10_000


class _Words(dict):
    """Word to 64-bit hash, emptied when full."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def grams(text: str | None, known: _Words) -> np.ndarray:
    """Buckets of the words and word pairs of a text, lower case; none for null and empty."""
    tokens = text.lower().split() if text else []
    one = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
    two = one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:]
    two = (two ^ (two >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (np.concatenate([one, two]) >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1)


def _chosen(labels: DataFrame, label: str, doc_id: str, max_rows: int) -> DataFrame:
    good = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("__id")).agg(
        F.min(F.col(label).cast("double")).alias("__good"))
    return good.filter("__good > 0").orderBy(F.xxhash64("__id"), "__id").limit(max_rows).select("__id")


def log_weights(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", doc_id: str = "doc_id",
                max_rows: int = MAX_ROWS) -> np.ndarray:
    """Log of target over raw probability of each bucket, both smoothed by one half; zeros without a good label."""
    lean(docs.sparkSession)
    chosen = _chosen(labels, label, doc_id, max_rows).withColumn("__target", F.lit(True))
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(chosen), "__id", "left").select(
        "__text", F.col("__target").isNotNull().alias("__target"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, sums = _Words(), np.zeros((2, BUCKETS), np.int64)
        for pdf in batches:
            for value, target in zip(pdf["__text"], pdf["__target"], strict=True):
                found = np.bincount(grams(value, known), minlength=BUCKETS)
                sums[1] += found
                if target:
                    sums[0] += found
        yield pd.DataFrame({"bucket": np.arange(BUCKETS), "target": sums[0], "raw": sums[1]})
    found = rows.mapInPandas(count, "bucket int, target long, raw long").groupBy("bucket").agg(
        F.sum("target").alias("target"), F.sum("raw").alias("raw")).toPandas()  # BUCKETS rows
    target, raw = np.zeros(BUCKETS), np.zeros(BUCKETS)
    target[found["bucket"]], raw[found["bucket"]] = found["target"], found["raw"]
    if not target.sum():
        return np.zeros(BUCKETS)
    return np.log((target + 0.5) / (target.sum() + BUCKETS / 2)) - np.log((raw + 0.5) / (raw.sum() + BUCKETS / 2))


def importance(docs: DataFrame, weights: np.ndarray, text: str = "text", doc_id: str = "doc_id", seed: int = 1) -> DataFrame:
    """(doc_id, log_ratio, key): log importance of every row, and the same plus a Gumbel number that follows from id, text and seed."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # BUCKETS numbers

    @F.pandas_udf("double")
    def column(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known, w = _Words(), shared.value
        for values in batches:
            yield pd.Series([float(w[grams(v, known)].sum()) for v in values], dtype="float64")
    rows = docs.select(F.col(doc_id), column(F.col(text)).alias("log_ratio"), uniform(doc_id, text, seed=seed).alias("__u"))
    return rows.select(doc_id, "log_ratio", (F.col("log_ratio") - F.log(-F.log("__u"))).alias("key"))


def kth_highest(keys: DataFrame, k: int, column: str = "key") -> float:
    """The k-th highest number of a column without nulls, for k from 1 to the number of rows."""
    low, high = keys.agg(F.min(column), F.max(column)).first()
    rest = k  # rank within [low, high]
    while True:
        inside = keys.filter(F.col(column).between(low, high))
        width = (high - low) / RANGES
        if width <= 0 or low + width == low or inside.count() <= FEW:
            break
        at = F.least(F.lit(RANGES - 1), F.floor((F.col(column) - low) / width)).cast("int")
        counts = {r.at: r for r in inside.groupBy(at.alias("at")).agg(
            F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()}  # RANGES rows
        for i in sorted(counts, reverse=True):
            if rest <= counts[i].n:
                low, high = counts[i].low, counts[i].high
                break
            rest -= counts[i].n
    if low == high:
        return low
    return inside.select(column).orderBy(F.desc(column)).limit(FEW).collect()[rest - 1][0]


def resampled(docs: DataFrame, labels: DataFrame, label: str = "quality", keep: float | None = None, text: str = "text",
              doc_id: str = "doc_id", seed: int = 1) -> DataFrame:
    """(doc_id, log_ratio, key, kept) for every row; ``kept`` marks the sample.

    The sample has the share ``keep`` of the rows, by default the share of good rows among the labelled.  Rows equal in id and
    text have equal keys and stay or go together.  A null or empty text has log importance 0.  Without labels all rows stay.
    """
    if keep is None:
        keep = labels.agg(F.avg(F.when(F.col(label) > 0, 1.0).when(F.col(label).isNotNull(), 0.0))).first()[0]
    scored = stored(importance(docs, log_weights(docs, labels, label, text, doc_id), text, doc_id, seed), "importance")
    total = scored.count()
    k = total if keep is None else min(total, round(keep * total))
    if k == 0:
        return scored.withColumn("kept", F.lit(False))
    return scored.withColumn("kept", F.col("key") >= F.lit(kth_highest(scored, k)))
