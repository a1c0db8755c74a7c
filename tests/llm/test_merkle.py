import hashlib
import zlib

import duckdb
import pytest

from larder.llm import merkle
from larder.llm.queries import QUERIES
from tests.conftest import SMALL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos int, digest int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def coded(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, text):
    return H(*[coded(r[k]) for k in ("doc_id", "source", "lang", "n_chars")], coded(text))


def tree(nodes):
    """Root, and for each node the digests left and right of its way."""
    ways = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            first = p - p % 16
            ways[i].append((nodes[first:p], nodes[p + 1:first + 16]))
            at[i] = p // 16
        nodes = [H(*nodes[i:i + 16]) for i in range(0, len(nodes), 16)]
    return nodes[0], ways


def expected(rows):
    """Rows as dicts."""
    first = lambda v: (v is not None, v or (0 if isinstance(v, int) else ""))
    by_source = {}
    for r in rows:
        by_source.setdefault(r["source"], []).append(r)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees, out = {}, []
    for s in sources:
        by_source[s].sort(key=lambda r: (first(r["doc_id"]), leaf(r, r["text"])))
        trees[s] = tree([leaf(r, r["text"]) for r in by_source[s]])
    root, above = tree([trees[s][0] for s in sources])
    for s, up in zip(sources, above, strict=True):
        for r, way in zip(by_source[s], trees[s][1], strict=True):
            text = r["text"]
            if text is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            at = leaf(r, text)
            for a, b in way + up:
                at = H(*a, at, *b)
            out.append((r["doc_id"], leaf(r, r["text"]), trees[s][0], root, H(*[x for a, b in way + up for x in a + b]), at, at == root))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_addresses_fill_a_tree_in_order():
    for height in (1, 2, 3, 4):
        all_of = [merkle.address(d, i, height) for d in range(height) for i in range(16 ** d)]
        assert sorted(all_of) == list(range(merkle.nodes_of(height)))
    # height 4 splits in two halves of 2: the top one first, then every bottom one in a stretch of its own
    assert [merkle.address(1, i, 4) for i in range(16)] == list(range(1, 17))
    assert [merkle.address(2, i, 4) for i in range(3)] == [17, 34, 51]
    assert [merkle.address(3, i, 4) for i in (0, 15, 16)] == [18, 33, 35]


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 272, 273, 1000, 4096])
def test_block(n):
    leaves = [H(str(i)) for i in range(n)]
    height = merkle.raised(n) + 1
    layout = merkle.build(leaves, height)
    root, ways = tree(leaves)
    assert layout[0] == root
    assert len(layout) <= max(1, 2 * n + 40)
    for i in {0, n // 2, n - 1}:
        assert list(merkle.siblings(layout, n, i, height)) == [("".join(a), "".join(b)) for a, b in ways[i]]


def test_whole_table(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert got(QUERIES["op11_veb_manifest"](spark, SMALL)) == expected([r.asDict() for r in rows])


def test_several_tiers(spark):
    """Blocks of 16 leaves: a hot source of three tiers, one leaf more than full, and many sources."""
    rows = [(i, f"Text {i}", None, "hot" if i < 257 else f"s{i % 40}é", i) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    assert got(merkle.digests(docs, levels=1)) == expected([r.asDict() for r in docs.collect()])


def test_edge_cases(spark):
    rows = [(None, "Null id", "en", "a", 7), (2**62 + 1, None, None, None, None), (3, "", "", "", 0), (4, "Ä B" * 200_000, "de", "a", 600_000),
            (5, "Same", "en", "b", 4), (5, "Same", "en", "b", 4), (5, "other", "en", "b", 5), (-7, "One LEAF", "x", "c", 8)]
    docs = spark.createDataFrame([(*r, "t", 1, 2) for r in ((a, b, c, d, e) for a, b, c, d, e in rows)], SCHEMA)
    want = expected([r.asDict() for r in docs.collect()])
    assert got(merkle.digests(docs)) == want
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "lang", "source", "n_chars").toArrow())
    names = "doc_id, leaf, subroot, root, proof_sha256, folded_root, verified"
    assert sorted(con.sql(f"SELECT {names} FROM ({merkle.sql()})").fetchall(), key=str) == want
    assert merkle.digests(docs.limit(0)).count() == 0
    one = docs.filter("doc_id = -7")
    row = merkle.digests(one).first()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == H("")
