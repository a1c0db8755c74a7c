import zlib
from collections import Counter, defaultdict

import pytest

from larder.llm import sharding
from larder.llm.queries import QUERIES
from tests.conftest import SMALL


def plain(rows, shards, first=0):
    """Shard of every row (size, keys): all rows of a node sorted, cut where the bytes are nearest to the left side's share."""
    if shards == 1 or not rows:
        return {i: first for i, _, _ in rows}
    spread = [max(k[d] for _, _, k in rows) // 2**38 - min(k[d] for _, _, k in rows) // 2**38 for d in range(3)]
    d = spread.index(max(spread))
    total, share = sum(s for _, s, _ in rows), shards // 2
    by_key = Counter()
    for _, s, k in rows:
        by_key[k[d]] += s
    best, done = None, 0
    for key in sorted(by_key):
        if done and (best is None or abs(done * shards - total * share) < best[0]):
            best = (abs(done * shards - total * share), key)
        done += by_key[key]
    cut = best[1] if best else min(by_key)
    return (plain([r for r in rows if r[2][d] < cut], share, first)
            | plain([r for r in rows if r[2][d] >= cut], shards - share, first + share))


def check(docs, got, shards):
    """Every row once with its size and checksum, gapless slots in order of ids, and the shards of the plain tree."""
    texts = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == texts
    by_shard = defaultdict(list)
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        by_shard[r.shard].append(r)
    for own in by_shard.values():
        own.sort(key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        ids = [(r.doc_id is not None, r.doc_id) for r in own]
        assert ids == sorted(ids)
    keyed = sharding.keyed_rows(docs, shards).collect()
    want = plain([(i, r["size"], (r.k0, r.k1, r.k2)) for i, r in enumerate(keyed)], shards)
    assert Counter((r.id, r.crc, want[i]) for i, r in enumerate(keyed)) == Counter((r.doc_id, r.text_crc32, r.shard) for r in got)
    return {s: sum(r.size for r in own) for s, own in by_shard.items()}


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = QUERIES["op13_kd_sharding"](spark, SMALL).collect()
    sums = check(docs, got, 40)
    assert max(sums.values()) <= sum(sums.values()) / 40 + max(r.size for r in got)
    assert sorted(got) == sorted(QUERIES["op13_kd_sharding"](spark, SMALL).collect())


def test_near_equal_and_groups(spark):
    """A third of the rows are copies, in many sources: shards stay near equal, and small groups stay whole."""
    rows = [(i, "hot text " * 30 if i % 3 == 0 else f"text {i // 4} " * 30, "ab"[i % 2], f"source{i % 7}", i % 5) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = sharding.sharded(docs, 7).collect()
    sums = check(docs, got, 7)
    assert len(sums) == 7 and max(sums.values()) < 1.03 * min(sums.values())
    groups = defaultdict(set)
    for r in got:
        groups[r.text_crc32].add(r.shard)
    assert sum(len(s) > 1 for s in groups.values()) == 1  # the hot one


def test_boxes_of_metadata(spark):
    """The first split lies along a dimension of full width, so sources far apart in it share no shard."""
    rows = [(i, f"text number {i}", "en", "a" if i % 2 else "z", 5) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    by = defaultdict(set)
    for r in sharding.sharded(docs, 4).collect():
        by[r.shard].add(r.doc_id % 2)
    assert [len(by[s]) for s in range(4)] == [1, 1, 1, 1]
    target = sharding.sharded(docs, target_bytes=4000).collect()
    assert max(r.shard for r in target) + 1 == -(-sum(r.size for r in target) // 4000)


@pytest.mark.parametrize("shards", [1, 3])
def test_edge_cases(spark, shards):
    schema = "doc_id long, text string, lang string, source string, n_chars long, size int, k0 int, pos int, id int"
    rows = [(None, "null id", None, None, None, 1, 1, 1, 1), (2**62 + 1, None, "en", "a", -5, 1, 1, 1, 1), (3, "", "en", "é" * 9, 0, 2, 2, 2, 2),
            (4, "long " * 100_000, "de", "a", 2**62, 3, 3, 3, 3), (5, "same", "en", "b", 4, 4, 4, 4, 4), (5, "same", "en", "b", 4, 4, 4, 4, 4)]
    docs = spark.createDataFrame(rows, schema)
    assert len(check(docs, sharding.sharded(docs, shards).collect(), shards)) <= shards
    assert sharding.sharded(docs.limit(0), shards).count() == 0
    assert sharding.sharded(docs.limit(0), target_bytes=100).count() == 0
    one = sharding.sharded(docs.filter("doc_id = 4"), shards).first()
    assert (one.size, one.slot) == (500_016, 0)
