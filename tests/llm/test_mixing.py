import math
from collections import Counter

import duckdb
import numpy as np
import pytest

from larder.llm import mixing
from larder.llm.queries import QUERIES
from tests.conftest import SMALL


def water(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Targets by sharing, capping and sharing the excess again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > most * sizes[s]}
        if not over:
            return {**out, **{s: level * w[s] for s in open_}}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def test_whole_table(spark):
    rows = duckdb.sql(f"""SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))
                          FROM '{SMALL}/documents.parquet'""").fetchall()
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    want = water(sizes)
    of = {i: (s, n) for i, s, n in rows}
    df = QUERIES["op1_hypergeometric_mixing"](spark, SMALL)
    got = df.collect()
    assert sorted(r.doc_id for r in got) == sorted(of)
    taken = Counter()
    for r in got:
        s, n = of[r.doc_id]
        assert (r["size"], r.source_size) == (n, sizes[s]) and math.isclose(r.target, want[s], rel_tol=1e-9)
        assert 0 <= r.taken <= 2 * n
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert sorted(got) == sorted(QUERIES["op1_hypergeometric_mixing"](spark, SMALL).collect())


def test_tree_gives_every_block_once(spark):
    quotas = spark.createDataFrame([([1000, 3, 0, 250, 77],)], "quota array<long>")
    leaves = sorted(mixing.split(quotas, 13, 5).collect())
    assert [r.shard for r in leaves] == list(range(13))
    for s, q in enumerate([1000, 3, 0, 250, 77]):
        at = 0
        for r in leaves:
            assert r.start[s] == at
            at += r.quota[s]
        assert at == q
    assert {sum(r.quota) for r in leaves} <= {102, 103}
    assert leaves == sorted(mixing.split(quotas, 13, 5).collect())


@pytest.mark.parametrize("r,q,d", [(40, 11, 17), (10, 10, 4), (7, 1, 3), (30, 28, 20), (2000, 600, 1000)])
def test_draws_are_hypergeometric(spark, r, q, d):
    n = 4000
    u = spark.range(n).selectExpr(f"(id + 0.5D) / {n} AS u")
    got = [x.x for x in u.selectExpr(mixing._draw(f"{r}L", f"{q}L", f"{d}L", "u") + " AS x").collect()]
    low, high = max(0, d - (r - q)), min(d, q)
    assert low <= min(got) and max(got) <= high
    def log_choose(a, b): return math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    counts = Counter(got)
    for k in range(low, high + 1):
        p = math.exp(log_choose(q, k) + log_choose(r - q, d - k) - log_choose(r, d))
        assert abs(counts[k] / n - p) <= 1.01 / n, (k, counts[k] / n, p)


def test_blocks_are_disjoint_and_shards_mixed(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CELL", 20)
    monkeypatch.setattr(mixing, "SHARD", 50)
    docs = spark.createDataFrame([(i, "w " * (10 + i % 50), f"s{min(3, i % 9)}") for i in range(300)], "doc_id long, text string, source string")
    _, draws = mixing.plan(mixing.sized(docs), block_words=16)
    rows = draws.collect()
    assert len({(r.k1, r.copy, r.block, r.epoch) for r in rows}) == len(rows)
    shards = Counter(r.shard for r in rows)
    assert max(shards.values()) - min(shards.values()) <= 1
    assert all({r.place for r in rows if r.shard == s} == set(range(1, n + 1)) for s, n in shards.items())
    share = Counter((r.shard, r.i) for r in rows)
    whole = Counter(r.i for r in rows)
    spread = [share[s, 0] / shards[s] - whole[0] / len(rows) for s in shards]
    assert np.abs(spread).max() < 0.35


def test_edge_cases(spark):
    schema = "doc_id long, text string, source string, size int, target string, i int"
    rows = [(1, "a b c d", "x", 1, "q", 1), (1, "a b c d", "x", 1, "q", 1), (2, None, None, 2, None, 2), (3, "", "y", 3, "", 3),
            (None, "one two three", None, 4, "n", 4), (4, "z " * 60_000, "z", 5, "t", 5)]
    docs = spark.createDataFrame(rows, schema)
    got = mixing.summary(docs).collect()
    sizes = {"x": 8, "y": 0, "z": 60_000, None: 3}
    want = water(sizes)
    assert sorted((r.doc_id or 0, r["size"]) for r in got) == [(0, 3), (1, 4), (1, 4), (2, 0), (3, 0), (4, 60_000)]
    for r in got:
        source = {0: None, 1: "x", 2: None, 3: "y", 4: "z"}[r.doc_id or 0]
        assert math.isclose(r.target, want[source]) and r.taken <= 2 * r["size"]
    assert sum(r.taken for r in got) == pytest.approx(sum(want.values()), abs=4)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    count = Counter(map(tuple, mixed.collect()))
    assert set(count) <= set(rows) and count[rows[0]] <= 4
    assert mixing.summary(docs.limit(0)).count() == 0 and mixing.mixed_documents(docs.limit(0)).count() == 0
