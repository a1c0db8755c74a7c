import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import toxicity
from tests.conftest import DATA


def test_logistic_matches_gradient():
    """The fit is where the penalised likelihood is flat."""
    rng = np.random.default_rng(0)
    x = np.column_stack([np.ones(400), rng.integers(0, 2, (400, 5))])
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [-1, 2, -1, 0, 1, 0.5])))).astype(float)
    w = toxicity.fit_logistic(x, y)
    p = 1 / (1 + np.exp(-x @ w))
    assert np.abs(x.T @ (p - y) + 0.1 * np.r_[0, w[1:]]).max() < 1e-3


def test_earlier_probabilities_are_out_of_fold():
    """The model of the second category sees, for each row, a probability fitted without the row's fold."""
    rng = np.random.default_rng(1)
    x = np.column_stack([np.ones(300), rng.integers(0, 2, (300, 4))])
    labels = rng.integers(0, 2, (300, 2)).astype(float)
    folds = np.arange(300) % 3
    first, second = toxicity.fit_chain(x, labels, folds)
    held = np.zeros(300)
    for f in range(3):
        w = toxicity.fit_logistic(x[folds != f], labels[folds != f, 0])
        held[folds == f] = 1 / (1 + np.exp(-x[folds == f] @ w))
    assert np.allclose(second, toxicity.fit_logistic(np.column_stack([x, held]), labels[:, 1]))
    assert len(first) == 5 and len(second) == 6


def test_held_out(spark):
    """Trained on half of the labels, right on the other half; about a tenth of the toxic texts here hold no recurring term."""
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    chain = toxicity.train(docs, labels.filter(half))
    rows = toxicity.score(docs.join(labels.filter(~half), "doc_id"), chain).select("toxic", "is_toxic", "p_toxic").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert len(toxic) > 100
    assert np.mean([r.is_toxic for r in toxic]) > 0.8 and np.mean([r.is_toxic for r in clean]) < 0.005


def test_edge_cases(spark):
    rows = [(i, "you idiot fool here" if i % 4 == 0 else "a calm line here", "x", i, i) for i in range(40)]
    rows += [(40, None, None, 1, 1), (None, "", "q", 2, 2), (41, "idiot " * 200_000, "z", 3, 3), (41, "idiot " * 200_000, "z", 3, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, p_toxic string, y int, terms int")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(40)] + [(None, 1), (3, None), (999, 1), (4, 1)],
                                   "doc_id long, toxic int")
    chain = toxicity.train(docs, labels)
    kept = toxicity.not_toxic(docs, chain)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([r for r in rows if "idiot" not in (r[1] or "")], key=repr)
    scored = toxicity.score(docs, chain)
    assert scored.columns == ["doc_id", "text", "y", "terms", "p_band_1", "p_band_2", "p_toxic", "is_toxic"]
    assert toxicity.not_toxic(docs.limit(0), chain).count() == 0


@pytest.mark.parametrize("kept", ["toxic = 0", "toxic IS NULL"])
def test_no_toxic_labels(spark, kept):
    docs = spark.createDataFrame([(1, "a b c"), (2, "d e f")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, None)], "doc_id long, toxic int").filter(kept)
    assert toxicity.not_toxic(docs, toxicity.train(docs, labels)).count() == 2


def test_one_worker_a_task(spark, monkeypatch):
    """No job of training, nor the scoring, sends its rows through Python twice, which takes two workers for each task."""
    plans = []
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    frame = type(spark.range(1))
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda df: plans.append(plan(df)) or collect(df))
    docs = spark.createDataFrame([(i, "you idiot fool here" if i % 4 == 0 else "a calm line here") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(40)], "doc_id long, toxic int")
    chain = toxicity.train(docs, labels)
    nodes = [len(re.findall(r"EvalPython|MapInArrow|MapInPandas", p)) for p in [*plans, plan(toxicity.not_toxic(docs, chain)), plan(toxicity.score(docs, chain))]]
    assert max(nodes) == 1 and sum(nodes) == 4


def test_terms_are_counted_whole(spark, monkeypatch):
    """Counts of a term by label are those of a plain count, however few terms a task may hold."""
    rows = [(i, " ".join(f"word{chr(97 + (i * j) % 23)}x" for j in range(1, 9)) + " Same same", float(i % 3 == 0)) for i in range(60)]
    rows += [(60, None, 1.0), (61, "", 0.0), (62, "\u00c4rger \u00e4rger 12 a", 1.0)]
    want = Counter((y, t) for _, text, y in rows for t in toxicity.terms(text))
    sample = spark.createDataFrame(rows, "__id long, __text string, y double")
    for most in (toxicity.HELD_TERMS, 5):
        monkeypatch.setattr(toxicity, "HELD_TERMS", most)
        got = Counter()
        for r in toxicity._counted(sample).collect():
            got[r.y, r.term] += r.n
        assert got == want
