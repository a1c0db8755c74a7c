from fractions import Fraction

import numpy as np
import pytest

from larder.llm import whitening
from larder.llm.queries import QUERIES
from tests.conftest import SMALL


def numbers(vectors):
    return np.floor(np.array(vectors, dtype=np.float64) * 64).astype(np.int64) + 1_000_000


def check(rows, ids, vectors, most=32):
    """Rows of the query against sums in whole numbers and a plain whitening."""
    x = numbers(vectors)
    n, d = x.shape
    exact = x.astype(object)
    s = exact.sum(axis=0)
    deviation = dict(zip(ids, ((n * exact - s) ** 2).sum(axis=1), strict=True))
    centred = x - (s.astype(np.float64) / n)
    v = np.array([[float(Fraction(int((exact[:, i] * exact[:, j]).sum()) * n - int(s[i] * s[j]), n * n)) for j in range(d)] for i in range(d)])
    values = np.linalg.eigvalsh(v)[::-1]
    k = max(r.component for r in rows)
    assert k <= most and len(rows) == n * k
    z = np.zeros((n, k))
    place = {i: p for p, i in enumerate(ids)}
    for r in rows:
        assert r.n == n and r.deviation == deviation[r.vec_id]
        assert r.explained == pytest.approx(values[r.component - 1] / np.trace(v), rel=1e-9)
        z[place[r.vec_id], r.component - 1] = r.whitened
    # each component is the projection on one unit eigenvector of v
    w = np.linalg.lstsq(centred, z, rcond=None)[0] * np.sqrt(values[:k])
    if n > d and values[-1] > 1e-6:
        assert np.abs(v @ w - w * values[:k]).max() < 1e-6 * values[0]
        assert np.abs((w ** 2).sum(axis=0) - 1).max() < 1e-6
    error = np.abs(np.cov(z.T, bias=True).reshape(k, k) - np.eye(k)).max()
    assert error < 1e-8 and {r.identity_error for r in rows} == {rows[0].identity_error}
    assert rows[0].identity_error < 1e-8


def test_whole_table(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    good = [(r.vec_id, r.embedding) for r in table if r.embedding is not None and all(e is not None and np.isfinite(e) for e in r.embedding)]
    check(QUERIES["op12_bit_sliced_whitening"](spark, SMALL).collect(), [i for i, _ in good], [e for _, e in good])


@pytest.mark.parametrize("high", [2, 1000, 2**31, 2**61])
@pytest.mark.parametrize("rows", [1, 63, 64, 65, 300])
def test_scatter_is_exact(high, rows):
    x = np.random.default_rng(rows).integers(-high, high, (rows, 5))
    x[:, 3] = 7
    n, s, c = whitening.scatter(x)
    exact = x.astype(object)
    assert n == rows and list(s) == list(exact.sum(axis=0))
    assert (c == exact.T @ exact).all()


def test_limbs():
    for v in (0, -1, 2**31, -(2**63), 3**70, -(3**70)):
        assert sum(x << (32 * k) for k, x in enumerate(whitening._limbs(v))) == v
        assert all(-(2**63) <= x < 2**63 for x in whitening._limbs(v))


def test_edge_cases(spark):
    rng = np.random.default_rng(1)
    fine = [(i, [float(v) for v in rng.normal(size=4)]) for i in range(40)]
    fine += [(100 + i, fine[0][1]) for i in range(20)]  # copies
    odd = [(200, None), (201, []), (202, [1.0, None, 2.0, 3.0]), (203, [float("nan")] * 4), (204, [float("inf"), 0.0, 0.0, 0.0]), (205, [1.0, 2.0])]
    rows = [(i, v, "x", 1, 2.0) for i, v in fine + odd]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string, n int, whitened double").repartition(3)
    check(whitening.components(docs).collect(), [i for i, _ in fine], [v for _, v in fine])
    assert max(r.component for r in whitening.components(docs, most=2).collect()) == 2
    assert whitening.components(docs.limit(0)).count() == 0
    assert whitening.components(docs.filter("vec_id >= 200 and vec_id < 205")).count() == 0
    same = whitening.components(docs.filter("vec_id >= 100 and vec_id < 120"))
    assert same.count() == 0 and same.columns[0] == "vec_id"
    nameless = spark.createDataFrame([(None, [0.5, 1.5]), (None, [1.0, -1.0]), (2**62 + 1, [0.25, 0.75])], "vec_id long, embedding array<float>")
    got = whitening.components(nameless).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == [(0, 1), (0, 1), (0, 2), (0, 2), (2**62 + 1, 1), (2**62 + 1, 2)]


def test_very_large_entries(spark):
    rows = [(i, [float(10.0 ** (i % 19)), float(i)]) for i in range(30)]
    got = whitening.components(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id for r in got} == set(range(30)) and all(r.deviation is None or r.deviation >= 0 for r in got)
    assert got[0].identity_error < 1e-4
