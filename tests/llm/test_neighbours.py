import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import neighbours
from larder.llm.queries import QUERIES
from tests.conftest import DATA


def brute(ids, vectors, k=5):
    """Exact neighbours of every id divisible by 50."""
    x = np.array(vectors, float)
    norm = np.sqrt((x * x).sum(1))
    out = {}
    for i in np.nonzero(np.array(ids) % 50 == 0)[0]:
        score = (x * x[i]).sum(1) / (norm * norm[i])
        out[ids[i]] = sorted(((-score[j], ids[j]) for j in range(len(ids)) if ids[j] != ids[i]))[:k]
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{DATA}/{sf}/embeddings.parquet'").fetchall()
    want = brute([r[0] for r in rows], [r[1] for r in rows])
    got = QUERIES["op5_prefix_forest"](spark, f"{DATA}/{sf}").collect()
    assert len(got) == 5 * len(want)
    score = {(q, v): -s for q, top in want.items() for s, v in top}
    found = [(r.query_id, r.vec_id) in score for r in got]
    assert np.mean(found) >= 0.95
    assert all(r.score == pytest.approx(score[r.query_id, r.vec_id], abs=1e-12) for r, f in zip(got, found) if f)
    for q in want:
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        assert mine == sorted(mine, key=lambda r: (-r.score, r.vec_id))


def test_recall_over_blocks(spark, monkeypatch):
    """Several blocks and chunks, clustered vectors and many near copies of one."""
    monkeypatch.setattr(neighbours, "BLOCK", 700)
    monkeypatch.setattr(neighbours, "CHUNK", 30)
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((20, 32))
    x = centres[rng.integers(0, 20, 4000)] + 0.6 * rng.standard_normal((4000, 32))
    x[1000:2200] = x[0] + 0.01 * rng.standard_normal((1200, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = brute(list(range(4000)), x)
    got = {(r.query_id, r.vec_id) for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0).collect()}
    assert np.mean([(q, v) in got for q, top in want.items() for _, v in top]) >= 0.95


def test_level_is_the_longest_common(spark):
    """The trees stand one bit above the length at which the ranges hold too few."""
    x = np.random.default_rng(3).standard_normal((500, 16))
    forest = neighbours.Forest(x, trees=8)
    q, c = forest.candidates(x[:20], near=4)
    strings = [neighbours.Forest._strings(x, p) for p in forest.planes]
    for i in range(20):
        share = np.array([[64 - int(s[i] ^ s[j]).bit_length() for j in range(500)] for s in strings])
        length = max(n for n in range(65) if (share >= n).sum() >= 4 * 8)
        assert set(c[q == i]) == set(np.nonzero((share >= length).any(0))[0])


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1, "a"), (1, [2.0, 0.0], 1, "b"), (2, [1.0, 0.0], 1, "c"), (3, [0.0, 1.0], 1, "d"), (3, [0.0, 1.0], 1, "d"),
            (4, None, 1, "e"), (5, [0.0, 0.0], 1, "f"), (6, [nan, 1.0], 1, "g"), (7, [inf, 1.0], 1, "h"), (8, [None, 1.0], 1, "i"),
            (None, [1.0, 0.0], 1, "j"), (50, [1.0, 1.0], 1, "k"), (100, [1.0, 1.0, 1.0], 1, "l"), (9, [-1.0, 0.0], 1, "m")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, score string")
    got = [tuple(r) for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert [r[:3] for r in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 50), (0, 4, 3), (0, 5, 9), (50, 1, 0), (50, 2, 1), (50, 3, 2), (50, 4, 3), (50, 5, 9)]
    assert got[0][3] == 1.0 and got[3][3] == 0.0 and got[4][3] == -1.0
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
