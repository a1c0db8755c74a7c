import math
from collections import Counter

import numpy as np
import pytest
import xxhash

from larder.llm import resampling
from larder.llm.queries import QUERIES
from tests.conftest import DATA, SMALL


def buckets(text):
    h = [xxhash.xxh64_intdigest(w) for w in (text or "").lower().split()]
    pairs = []
    for a, b in zip(h, h[1:]):
        x = (a * 0x9E3779B97F4A7C15 + b) % 2**64
        pairs.append((x ^ x >> 29) * 0xBF58476D1CE4E5B9 % 2**64)
    return [(x >> 40) % resampling.BUCKETS for x in h + pairs]


def test_whole_table_by_hand(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet").collect() for t in ("documents", "labels"))
    good = {r.doc_id for r in labels if r.quality}
    raw, target = Counter(), Counter()
    for d in docs:
        raw.update(buckets(d.text))
        if d.doc_id in good:
            target.update(buckets(d.text))
    n, t = sum(raw.values()), sum(target.values())
    half = resampling.BUCKETS / 2
    w = [math.log((target[b] + .5) / (t + half)) - math.log((raw[b] + .5) / (n + half)) for b in range(resampling.BUCKETS)]
    got = {r.doc_id: r for r in QUERIES["op4_gumbel_resampling"](spark, SMALL).collect()}
    assert set(got) == {d.doc_id for d in docs}
    for d in docs:
        assert got[d.doc_id].log_ratio == pytest.approx(sum(w[b] for b in buckets(d.text)), abs=1e-6)
    k = round(len(docs) * len(good) / len(labels))
    assert {r.doc_id for r in got.values() if r.kept} == {r.doc_id for r in sorted(got.values(), key=lambda r: -r.key)[:k]}


def test_good_documents_stay(spark):
    rows = QUERIES["op4_gumbel_resampling"](spark, f"{DATA}/sf0.1")
    labels = spark.read.parquet(f"{DATA}/sf0.1/labels.parquet")
    share = {r.quality: r.s for r in rows.join(labels, "doc_id").groupBy("quality").agg({"kept": "count"}).withColumnRenamed("count(kept)", "s").collect()}
    kept = {r.quality: r.n for r in rows.filter("kept").join(labels, "doc_id").groupBy("quality").count().withColumnRenamed("count", "n").collect()}
    assert kept[1] / share[1] > 0.9 and kept.get(0, 0) / share[0] < 0.4


@pytest.mark.parametrize("values", [[1.0] * 50, list(range(3000)), [0.0, -1e9, 1e9, 5.0, 5.0, 5.0], [1e-300, 0.0, -1e-300]])
def test_kth_highest(spark, monkeypatch, values):
    monkeypatch.setattr(resampling, "FEW", 5)
    monkeypatch.setattr(resampling, "RANGES", 7)
    df = spark.createDataFrame([(float(v),) for v in values], "key double")
    for k in {1, 2, len(values) // 2, len(values)}:
        assert resampling.kth_highest(df, k) == sorted(values, reverse=True)[k - 1]


def test_samples_in_proportion(spark):
    """Over many seeds the first drawn follows the importance."""
    base = spark.createDataFrame([(0, 0.0), (1, math.log(3.0))], "doc_id long, w double").collect()
    from pyspark.sql import functions as F
    df = spark.range(4000).select(*[(F.lit(r.w) - F.log(-F.log(resampling.uniform("id", F.lit(r.doc_id), seed=9)))).alias(f"k{r.doc_id}") for r in base])
    assert np.mean([r.k1 > r.k0 for r in df.collect()]) == pytest.approx(0.75, abs=0.03)


def test_edge_cases(spark):
    schema = "doc_id long, text string, key string, kept int, log_ratio int"
    rows = [(1, "a b c", "x", 1, 1), (1, "a b c", "x", 1, 1), (2, None, None, 2, 2), (None, "d e", "y", 3, 3), (3, "", "z", 4, 4), (4, "w " * 90_000, "q", 5, 5)]
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    got = resampling.resampled(docs, labels, keep=0.5).collect()
    assert len(got) == 6 and {r.log_ratio for r in got if r.doc_id in (2, 3)} == {0.0} and 3 <= sum(r.kept for r in got) <= 4
    assert resampling.resampled(docs, labels.limit(0)).filter("kept").count() == 6
    assert resampling.resampled(docs.limit(0), labels).count() == 0
    assert resampling.resampled(docs, labels, keep=0.0).filter("kept").count() == 0
