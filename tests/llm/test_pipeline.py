from collections import Counter

import corpus_pipeline
from larder.llm import rlz, simhash, toxicity
from tests.conftest import DATA
from tests.llm.test_mixing import water
from tests.llm.test_packing import check
from tests.llm.test_rlz import split
from tests.llm.test_simhash import closure, plain

SF = f"{DATA}/sf0.001"


def test_stages_against_plain_versions(spark):
    """Every stage on what the one before kept, each against a version without Spark."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    before = {r.doc_id: r for r in docs.collect()}

    clean = stages["toxicity"](spark, docs, SF)
    chain = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    p = chain.predict([r.text for r in before.values()])[:, -1]
    kept = {r.doc_id: r for r in clean.collect()}
    assert kept == {i: r for (i, r), x in zip(before.items(), p) if x <= 0.5} and 0.9 < len(kept) / len(before) < 1

    unique = stages["simhash_near_dedup"](spark, clean, SF)
    roots = closure([plain(r.text) for r in kept.values()], 4)
    least = {}
    for i, r in zip(kept, roots):
        least[r] = min(i, least.get(r, i))
    ones = {r.doc_id: r for r in unique.collect()}
    assert ones == {i: kept[i] for i in least.values()}

    cut = stages["rlz_substring_dedup"](spark, unique, SF)
    rows = {r.doc_id: r for r in cut.collect()}
    seen = Counter(tuple(w[a:a + 35]) for w in map(split, (r.text for r in ones.values())) for a in range(len(w) - 34))
    for i, r in ones.items():
        w = split(r.text)
        gone = {x for a in range(len(w) - 34) if seen[tuple(w[a:a + 35])] > 1 for x in range(a, a + 35)}
        text = " ".join(x for n, x in enumerate(w) if n not in gone) if gone else r.text
        assert rows[i].text == text and rows[i].n_chars == (len(text) if gone else r.n_chars)
    assert set(rows) == set(ones)

    mixed = stages["hypergeometric_mixing"](spark, cut, SF)
    sizes, words, largest = Counter(), Counter(), Counter()
    for r in rows.values():
        sizes[r.source] += len(split(r.text))
        largest[r.source] = max(largest[r.source], len(split(r.text)))
    out = mixed.collect()
    for r in out:
        assert r == rows[r.doc_id]
        words[r.source] += len(split(r.text))
    want = water(sizes)
    assert all(abs(words[s] - want[s]) <= largest[s] / 2 + 1 for s in want)
    assert max(Counter(r.doc_id for r in out).values()) <= 2
    for df in (clean, unique, cut, mixed):
        assert df.columns == columns

    from tokenizers import Tokenizer
    from larder.llm.queries import vocabulary
    once = mixed.dropDuplicates(["doc_id"])
    packed = stages["residual_packing"](spark, once, SF).collect()
    check(packed, [(r.doc_id, r.text) for r in rows.values() if r.doc_id in {x.doc_id for x in out}], Tokenizer.from_file(vocabulary()[0]), 2048)


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(rows[0].asDict())
    filled = Counter()
    for r in rows:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 2048


def test_nulls_ties_and_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "some words here", None, "b", 15), (3, "good text " * 60, "en", "a", 600),
            (3, "good text " * 60, "en", "a", 600), (4, "w " * 30_000, "en", "b", 60_000)]
    for name, part in (("some", rows), ("none", [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(part, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(3, 1, 0), (4, 1, None)] if part else [], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        result = corpus_pipeline.run(spark, folder)
        assert (result.count() > 0) == bool(part)
    assert rlz and simhash
