import hashlib
import random
from collections import Counter

import duckdb
import pytest

from larder.llm import rlz
from larder.llm.queries import QUERIES
from tests.conftest import SMALL


def split(text):
    for c in "\t\n\v\f\r":
        text = (text or "").replace(c, " ")
    return [w for w in text.split(" ") if w]


def plain(rows, window):
    """(id, words, removed, hash of the kept words) by counting every window."""
    tokens = [split(t) for _, t in rows]
    seen = Counter(tuple(w[i:i + window]) for w in tokens for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, tokens):
        gone = set()
        for a in range(len(w) - window + 1):
            if seen[tuple(w[a:a + window])] > 1:
                gone.update(range(a, a + window))
        kept = " ".join(x for n, x in enumerate(w) if n not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr)


def test_whole_table(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall()
    assert got(QUERIES["op9_rlz_substring_dedup"](spark, SMALL)) == plain(rows, 35)


@pytest.mark.parametrize("seed", range(4))
def test_random_mixtures(spark, seed, monkeypatch):
    """Few words, short windows, cut and spliced passages, periodic texts, blocks smaller than documents."""
    monkeypatch.setattr(rlz, "BLOCK", 50)
    rng = random.Random(seed)
    pool = [[rng.choice("abcdefgh") + str(rng.randint(0, 2 + seed)) for _ in range(rng.randint(5, 60))] for _ in range(12)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(pool)
            a = rng.randint(0, len(p))
            w += p[a:a + rng.randint(3, 50)]
            w += [f"x{rng.randint(0, 9999)}" for _ in range(rng.randint(0, 4))]
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(w)))
    rows += [(100, "w " * 90), (101, "w " * 20), (102, "p q " * 40), (103, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(rlz.digest(docs, window=12)) == plain(rows, 12)


def test_factors_are_matches(spark):
    passage = " ".join(f"w{i}" for i in range(80))
    rows = [(1, "a b c " + passage + " d e"), (2, passage), (3, "q " + passage + " z"), (4, "nothing here")]
    docs = {r.doc_id: r for r in rlz.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = {i: split(t) for i, t in rows}
    for i, r in docs.items():
        for f in r.factors:
            assert text[i][f.start:f.start + f.length] == text[f.ref][f.ref_start:f.ref_start + f.length]
    assert [(f.start, f.length, f.ref, f.ref_start) for f in docs[2].factors] == [(0, 80, 1, 3)]
    assert docs[4].factors == [] and docs[3].n_removed == 80


def test_edge_cases(spark):
    long = " ".join(f"v{i}" for i in range(40))
    schema = "doc_id long, text string, factors string, n_chars long, s int, k int"
    rows = [(1, long, "a", 1, 1, 1), (1, long, "a", 1, 1, 1), (None, None, None, None, None, None), (2, "", "b", 0, 2, 2),
            (None, "one two", "c", 7, 3, 3), (3, "tail " + long, "d", 9, 4, 4)]
    docs = spark.createDataFrame(rows, schema)
    assert got(rlz.digest(docs)) == plain([r[:2] for r in rows], 35)
    out = rlz.without_repeats(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(
        [(1, "", "a", 0, 1, 1)] * 2 + rows[2:5] + [(3, "tail", "d", 4, 4, 4)], key=repr)
    assert rlz.digest(docs.limit(0)).count() == 0


def test_texts_travel_once(spark):
    df = QUERIES["op9_rlz_substring_dedup"](spark, SMALL)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].split("\n")
    assert len([x for x in plan if "REPARTITION_BY_NUM" in x and "Reused" not in x]) == 1
