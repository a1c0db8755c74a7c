import duckdb
import numpy as np
import pytest
import xxhash

from larder.llm import simhash
from tests.conftest import SMALL


def plain(text, k=4):
    """Fingerprint, bit by bit."""
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        t = t.replace(c, " ")
    w = [x for x in t.split(" ") if x]
    if not w:
        return 0
    s = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def closure(values, bits):
    parent = list(range(len(values)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= bits:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(values))]


@pytest.mark.parametrize("text", [None, "", " \t", "One", "a b c", "A b C d", "x y z w q r É é", "w " * 70000])
def test_fingerprint(text):
    assert simhash.simhash(text) & (2**64 - 1) == plain(text)


@pytest.mark.parametrize("kind", ["near", "chain", "dense", "random"])
def test_index_finds_every_link(kind):
    rng = np.random.default_rng(3)
    values = rng.integers(0, 2**63, 700, dtype=np.uint64)
    if kind == "near":
        values = np.concatenate([values, values[:300] ^ (np.uint64(1) << rng.integers(0, 63, 300).astype(np.uint64))])
    if kind == "chain":
        values = np.bitwise_xor.accumulate(np.uint64(5) << rng.integers(0, 60, 600).astype(np.uint64))
    if kind == "dense":
        values = values[0] ^ np.bitwise_or(*(np.uint64(1) << rng.integers(0, 63, (2, 900)).astype(np.uint64)))
    values = np.unique(values)
    u, v = simhash.GrayIndex(values, 4).star()
    at = {int(x): i for i, x in enumerate(values)}
    got = closure_of_edges(len(values), [(at[int(a)], at[int(b)]) for a, b in zip(u, v)])
    want = closure([int(x) for x in values], 4)
    assert partition(got) == partition(want)


def closure_of_edges(n, edges):
    label = list(range(n))
    for a, b in edges * 1:
        x, y = label[a], label[b]
        label = [x if z == y else z for z in label]
    return label


def partition(labels):
    groups = {}
    for i, x in enumerate(labels):
        groups.setdefault(x, []).append(i)
    return sorted(map(tuple, groups.values()))


def test_large_blocks_are_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LARGEST_BLOCK", 40)
    monkeypatch.setattr(simhash, "MEAN_BLOCK", 100)
    rng = np.random.default_rng(4)
    base = np.uint64(0x123456789ABCDEF0)
    values = np.unique(base ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 63, (9, 300)).astype(np.uint64)))
    table = spark.createDataFrame([(int(x),) for x in values.view(np.int64)], "fp long")
    edges = [(r.u, r.v) for r in simhash.links(table, 4).collect()]
    at = {int(x): i for i, x in enumerate(values.view(np.int64))}
    got = closure_of_edges(len(values), [(at[a], at[b]) for a, b in edges])
    assert partition(got) == partition(closure([int(x) for x in values], 4))


def test_whole_table(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet' ORDER BY 1").fetchall()
    from larder.llm.queries import QUERIES
    got = sorted(tuple(r) for r in QUERIES["op6_simhash_near_dedup"](spark, SMALL).collect())
    values = [plain(t) for _, t in rows]
    roots = closure(values, 4)
    least = {}
    for (i, _), r in zip(rows, roots):
        least[r] = min(i, least.get(r, i))
    assert got == [(i, f"{v:016x}", least[r]) for (i, _), v, r in zip(rows, values, roots)]


def test_edge_cases(spark):
    schema = "doc_id long, text string, fp string, k1 int, component_id int"
    rows = [(5, "a b c d e", "x", 1, 1), (3, "A B C D E", None, 2, None), (None, "a b c d e", "z", 3, 3),
            (7, None, "n", 4, 4), (8, "", "e", 5, 5), (None, "other words here now", "q", 6, 6), (5, "a b c d e", "x", 1, 1)]
    docs = spark.createDataFrame(rows, schema)
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert simhash.near_duplicates(docs).count() == 7
    assert got[(5, got_key(got, 5))] == 3 and got[(7, "0" * 16)] == 7 and got[(8, "0" * 16)] == 7
    kept = sorted(map(tuple, simhash.representatives(docs).collect()), key=repr)
    assert kept == sorted([rows[1], rows[3], rows[5]], key=repr)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.representatives(docs.limit(0)).count() == 0
    assert simhash.representatives(docs).columns == docs.columns


def got_key(got, doc_id):
    return next(f for d, f in got if d == doc_id)
