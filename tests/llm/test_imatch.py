import hashlib
import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from larder.llm import imatch
from larder.llm.queries import QUERIES
from tests.conftest import SMALL


def signed(x):
    return x - 2**64 if x >> 63 else x


def terms(text):
    return {signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w}


def plain(text, band):
    """Fingerprint of one text, thinned by its number of distinct terms in the band."""
    own_band = terms(text) & band
    rank = lambda h: (h % 2**64) >> 11
    x = max(0.0, math.log2(max(1, len(own_band)) / imatch.RETAIN))
    kept = [h for h in own_band if rank(h) < 2 ** (53 - math.floor(x + (h & 63) / imatch.SUBSETS))]
    kept = kept or sorted(own_band, key=lambda h: (rank(h), h))[:1]
    if not kept:
        return [signed(xxhash.xxh64_intdigest(text.encode(), 42)) % 65535 + 1, *[0] * 63]
    out = []
    for b in range(imatch.SUBSETS):
        own, value = sorted(h for h in kept if h & 63 == b), 42
        for h in own:
            value = xxhash.xxh64_intdigest(h.to_bytes(8, "little", signed=True), value)
        out.append(signed(value) % 65535 + 1 if own else 0)
    return out


def like(a, b):
    either = sum(1 for x, y in zip(a, b) if x or y)
    return sum(1 for x, y in zip(a, b) if x == y and x) / either


def expected(rows):
    texts = [t or "" for _, t in rows]
    df = Counter(h for t in texts for h in terms(t))
    band = {h for h, n in df.items() if n <= max(2, int(0.1 * len(rows)))}
    prints, out = [plain(t, band) for t in texts], []
    for i, (d, _) in enumerate(rows):
        n, nxt = len(texts[i]), (i + 1) % len(rows)
        edited = texts[i][:n - n // 2] + texts[nxt][:n // 2]
        e = plain(edited, band)
        text = lambda s: "".join(f"{v:04x}" for v in s)
        out.append((d, n, hashlib.sha256(edited.encode()).hexdigest(), text(prints[i]), text(e), like(prints[i], e), like(prints[i], prints[nxt])))
    return out


def test_whole_table(spark, monkeypatch):
    monkeypatch.setattr(imatch, "RANGE", 30)
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet' ORDER BY doc_id").fetchall()
    got = sorted(map(tuple, QUERIES["op8_imatch_fingerprints"](spark, SMALL).collect()))
    assert got == expected(rows)
    near, far = np.array([r[5] for r in got]), np.array([r[6] for r in got])
    assert near.mean() > 0.2 and far.mean() < 0.05 and (near > far).mean() > 0.94


def test_sparse_ids(spark, monkeypatch):
    monkeypatch.setattr(imatch, "RANGE", 4)
    rows = [(i * i * 1_000_003 - 500, f"word{i} shared{i % 3} tail{i} some {'x ' * i}é") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, imatch.fingerprints(docs).collect())) == expected(rows)


def test_edge_cases(spark):
    schema = "doc_id long, text string, fingerprint string, pos int, info int"
    one = spark.createDataFrame([(1, "only one here", "x", 1, 1)], schema)
    assert [tuple(r) for r in imatch.fingerprints(one).collect()] == expected([(1, "only one here")])
    rows = [(None, "null id first", "x", 1, 1), (1, None, None, 2, 2), (2, "", "y", 3, 3), (3, "z", "z", 4, 4), (4, "same text here", "q", 5, 5), (5, "same text here", "r", 6, 6),
            (6, "long words " * 40_000, "s", 7, 7)]
    got = sorted((tuple(r) for r in imatch.fingerprints(spark.createDataFrame(rows, schema)).collect()), key=lambda r: r[0] or -1)
    assert got == expected([r[:2] for r in rows])
    assert got[4][3] == got[5][3] and got[4][6] == 1.0
    twice = imatch.fingerprints(spark.createDataFrame(rows + rows[3:5], schema))
    assert twice.count() == 9
    assert imatch.fingerprints(spark.createDataFrame([], schema)).count() == 0


def test_repetitive_text_keeps_its_terms(spark):
    """A long text of few distinct terms: one more word leaves it near."""
    long = " ".join(f"term{i}" for i in range(12)) + " "
    rows = [(1, long * 400), (2, "inserted " + long * 400), (3, "another text"), (4, "cut word"), (5, "ano")]
    got = sorted(map(tuple, imatch.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == expected(rows)
    assert got[0][3].count("0000") < 60 and got[0][6] > 0.7


def test_ranges_hold_alike_many_rows(spark, monkeypatch):
    """Ids close together with one far off, at both ends of 64 bits, one id with a third of the rows, many null."""
    monkeypatch.setattr(imatch, "RANGE", 20)
    ids = [*range(200), 2**63 - 1, -2**63, *[77] * 200, *[None] * 200]
    docs = spark.createDataFrame([(d, f"text {i}") for i, d in enumerate(ids)], "doc_id long, text string")
    rows = docs.select(F.col("doc_id").alias("id"), *imatch.row_keys("doc_id", "text"))
    parted = rows.withColumn("part", imatch._range(rows)).collect()
    sizes = Counter(r.part for r in parted)
    assert max(sizes.values()) <= 60 and len(sizes) >= 25
    key = lambda r: (r.id is not None, r.id or 0, r.k1, r.k2)
    parts = [r.part for r in sorted(parted, key=key)]
    assert parts == sorted(parts)
    got = imatch.with_next(docs, "text", "doc_id").collect()
    of_key = {r.pos: r for r in got}
    assert len(of_key) == len(ids)
    first = min(got, key=lambda r: r.pos)
    seen, at = [], first
    for _ in ids:
        seen.append(at.id)
        assert of_key[at.next_pos].t == at.next_t
        at = of_key[at.next_pos]
    assert at == first and seen == sorted(ids, key=lambda d: (d is not None, d or 0))


def test_cuts_are_counted(spark):
    cuts = [1, 3, 3, 3, 8, 9, 9, 20, 21, 22, 40]
    ids = spark.range(-2, 45)
    got = ids.select("id", imatch._among(cuts, lambda c: c < F.col("id")).alias("a"), imatch._among(cuts, lambda c: c <= F.col("id")).alias("b")).collect()
    assert all(r.a == sum(c < r.id for c in cuts) and r.b == sum(c <= r.id for c in cuts) for r in got)


def test_other_id_types(spark):
    docs = spark.createDataFrame([("a", "x")], "doc_id string, text string")
    with pytest.raises(ValueError, match="whole numbers"):
        imatch.fingerprints(docs)
    short = spark.createDataFrame([(1, "x y"), (2, "z")], "doc_id int, text string")
    assert sorted(map(tuple, imatch.fingerprints(short).collect())) == expected([(1, "x y"), (2, "z")])
