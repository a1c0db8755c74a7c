import zlib
from collections import defaultdict

import duckdb
import pytest

from larder.llm import packing
from larder.llm.queries import QUERIES, vocabulary
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(vocabulary()[0])


@pytest.mark.parametrize("text", [
    "", " ", "  a", "a  b", "a \n b", "it's  we'll\tno ", "x  y", "　 　z", "a" * 300 + " b", "1 22  333 . .. ... \r\n\r\n end  ",
    "one<|endoftext|> two <|endoftext|>", "É à ß 日本 語 🙂 🙂🙂", "tab\t tab", "  x \x1c y \x85 z", " lead and trail "])
def test_same_ids(tokenizer, text):
    for files in (vocabulary(), vocabulary()[:1]):
        got = packing.Encoder(*files, most=3)(text)
        assert got == b"".join(i.to_bytes(4, "little") for i in tokenizer.encode(text, add_special_tokens=False).ids)


def check(rows, docs, tokenizer, size):
    """Every document whole and in order, every sequence gapless and in bounds; the number of sequences."""
    of = defaultdict(list)
    for r in rows:
        of[r.doc_id].append(r)
    assert set(of) == {i for i, _ in docs}
    for i, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        mine = sorted(of[i], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine))) and sum(r.length for r in mine) == len(ids)
        assert len(mine) == -(-len(ids) // size) and all(r.length == size for r in mine[1:])
        for r in mine:
            part = b"".join(x.to_bytes(4, "little") for x in ids[r.start:r.start + r.length])
            assert r.ids_crc32 == zlib.crc32(part) and len(part) == 4 * r.length
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for a, n in sorted(parts):
            assert a == at
            at += n
        assert at <= size
    return len(sequences)


def test_whole_table(spark, tokenizer):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall()
    rows = QUERIES["op3_residual_packing"](spark, SMALL).collect()
    n = check(rows, docs, tokenizer, 2048)
    assert n <= 1.03 * -(-sum(r.length for r in rows) // 2048) + 1


def test_rounds(spark, tokenizer, monkeypatch):
    """Many tasks, few items each: several rounds, and hardly more sequences than tokens need."""
    monkeypatch.setattr(packing, "PIECES", 20)
    docs = [(i, "a b c d e f g " * (1 + i * 7 % 23)) for i in range(900)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(24)
    rows = packing.packed(df, vocabulary(), size=256, slack=2).collect()
    assert check(rows, docs, tokenizer, 256) <= 1.03 * sum(r.length for r in rows) / 256 + 1


def test_best_fit():
    bins, offsets, count = packing.best_fit([6, 4, 5, 5, 3], 10)
    assert count == 3 and bins[0] == bins[1] and bins[2] == bins[3] and offsets[1] == 6
    assert packing.best_fit([], 10) == ([], [], 0)


def test_edge_cases(spark, tokenizer):
    schema = "doc_id long, text string, piece string, bin int, at int, length int"
    rows = [(1, None, "x", 1, 1, 1), (2, "", None, 2, 2, 2), (None, "null id", "y", 3, 3, 3), (3, "long " * 9000, "z", 4, 4, 4)]
    docs = spark.createDataFrame(rows, schema)
    got = packing.packed(docs, vocabulary())
    check(got.collect(), [r[:2] for r in rows], tokenizer, 2048)
    twice = packing.packed(docs.union(docs), vocabulary()).collect()
    assert len(twice) == 2 * got.count()
    assert len({(r.sequence_id, r.offset) for r in twice}) == len(twice)
    assert packing.packed(docs.limit(0), vocabulary()).count() == 0
