"""Toxicity by a classifier chain of linear models.

The chain predicts its categories one after another.  Each model is a logistic regression whose inputs are
the text's terms and the probabilities of all earlier categories.  A later model must not
learn from probabilities that were fitted on the same rows, so in training they are out-of-fold: rows are dealt
into folds, and a row's probability comes from a model of the other folds.  At prediction
the full models feed each other.

Categories are columns of 0 and 1.  The labels given know only "toxic", so the categories before it are
derived from the labelled rows themselves: the toxic terms are ranked by their weight of evidence and dealt
into *bands* (the strongest signs, the next, ...), and a row belongs to a band if it is toxic and holds such a term.

Terms are whole words and word beginnings of three to five letters, as insults inflect.  Which terms count follows from the
labelled sample, with counts made by Spark; fitting takes a bounded sample (``MAX_ROWS`` rows and ``MAX_TERMS`` terms),
the scoring of all documents is one pass over whole texts without an exchange.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import give_back, lean, stored

#: Bounds of the training sample: labelled rows (least by a hash of their id), and terms.
MAX_ROWS, MAX_TERMS = 10_000, 300
#: Terms that a task holds while it counts.
HELD_TERMS = 50_000
_WORD = re.compile(r"[^\W\d_]+")


def terms(text: str | None) -> set[str]:
    """Distinct words and word beginnings of a text, lower case; none for null."""
    found = set(_WORD.findall(text.lower())) if text else set()
    heads = {w[:n] + "*" for n in (3, 4, 5) for w in found if len(w) > n}
    return found | heads


@dataclass
class Chain:
    """A fitted chain: one row of coefficients for each category, over bias, terms and earlier categories."""

    vocabulary: list[str]
    categories: list[str]
    coefficients: list[np.ndarray] = field(default_factory=list)
    threshold: float = 0.5

    def matrix(self, texts) -> np.ndarray:
        """Bias and presence of each term, a row for each text."""
        words = {t: i + 1 for i, t in enumerate(self.vocabulary) if not t.endswith("*")}
        heads = {t[:-1]: i + 1 for i, t in enumerate(self.vocabulary) if t.endswith("*")}
        lengths = sorted({len(h) for h in heads})
        x = np.zeros((len(texts), len(self.vocabulary) + 1))
        x[:, 0] = 1
        for row, text in enumerate(texts):
            if not text:
                continue
            found = set(_WORD.findall(text.lower()))
            for w in words.keys() & found:
                x[row, words[w]] = 1
            for n in lengths:
                for h in heads.keys() & {w[:n] for w in found if len(w) > n}:
                    x[row, heads[h]] = 1
        return x

    def predict(self, texts) -> np.ndarray:
        x = self.matrix(texts)
        for weights in self.coefficients:
            x = np.column_stack([x, _probability(x, weights)])
        return x[:, len(self.vocabulary) + 1:]


def _probability(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.1, steps: int = 25) -> np.ndarray:
    """Coefficients of a logistic regression with a square penalty (not on the bias, column 0), by Newton steps."""
    w = np.zeros(x.shape[1])
    share = np.clip(y.mean() if len(y) else 0.0, 1e-4, 1 - 1e-4)
    w[0] = np.log(share / (1 - share))
    ridge = np.full(x.shape[1], penalty)
    ridge[0] = 1e-6
    for _ in range(steps):
        p = _probability(x, w)
        gradient = x.T @ (p - y) + ridge * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        move = np.linalg.solve(hessian, gradient)
        move *= min(1.0, 5 / max(1e-12, np.abs(move).max()))
        w -= move
        if np.abs(move).max() < 1e-5:
            break
    return w


def fit_chain(x: np.ndarray, labels: np.ndarray, folds: np.ndarray) -> list[np.ndarray]:
    """Coefficients of each category in order; earlier probabilities enter out-of-fold."""
    coefficients = []
    for k in range(labels.shape[1]):
        y = labels[:, k]
        coefficients.append(fit_logistic(x, y))
        held_out = np.zeros(len(y))
        for fold in np.unique(folds):
            out = folds == fold
            rest = ~out if (~out).any() else out
            held_out[out] = _probability(x[out], fit_logistic(x[rest], y[rest]))
        x = np.column_stack([x, held_out])
    return coefficients


def _sample(docs: DataFrame, labels: DataFrame, label: str, text: str, doc_id: str, max_rows: int) -> DataFrame:
    """(id, text, y) of the labelled rows, at most ``max_rows``: those least by a hash of the id.  Null labels do not count.

    A document that repeats an id counts once, with the least of its texts; of several labels the largest counts.
    """
    chosen = (labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
              .groupBy(F.col(doc_id).alias("__id")).agg(F.max(F.col(label).cast("double")).alias("y"))
              .orderBy(F.xxhash64("__id"), "__id").limit(max_rows))
    texts = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"))
    first = texts.join(F.broadcast(chosen), "__id").groupBy("__id").agg(F.min("__text").alias("__text"), F.max("y").alias("y"))
    return first.select("__id", "__text", "y")


def _counted(sample: DataFrame) -> DataFrame:
    """(y, term, n): the number of texts with a label that hold a term; a pair comes more than once, so that a task holds few.

    Terms are counted where they are found.  Arrays of them would be held for a whole batch, and Spark asks for a column once more
    in the filter that it puts below its explode: a second worker for each task.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([y for y, _ in held], pa.float64()), pa.array([t for _, t in held], pa.string()),
                                              pa.array(held.values(), pa.int64())], ["y", "term", "n"])
            held.clear()
            return out
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.update((y, t) for t in terms(text.as_py()))
                if len(held) >= HELD_TERMS:
                    yield flush()
        if held:
            yield flush()
        give_back()
    return sample.select("y", "__text").mapInArrow(count, "y double, term string, n long")


def _vocabulary(sample: DataFrame, max_terms: int) -> list[str]:
    """The terms that tell most about the label, strongest sign of toxic first, counted over the whole sample."""
    n = {r.y > 0.5: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = n.get(True, 0), n.get(False, 0)
    counts = _counted(sample).groupBy("term").agg(
        F.sum(F.col("y") * F.col("n")).alias("a"), F.sum((1 - F.col("y")) * F.col("n")).alias("b")).filter("a + b >= 3")
    a, b = (F.col("a") + 0.5) / (toxic + 1), (F.col("b") + 0.5) / (clean + 1)
    evidence = (a - b) * F.log(a / b)
    ranked = counts.select("term", evidence.alias("evidence"), F.log(a / b).alias("odds"))
    top = ranked.orderBy(F.desc("evidence"), "term").limit(max_terms)
    return [r.term for r in top.orderBy(F.desc(F.col("odds") * F.col("evidence")), "term").collect()]


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", bands: int = 2, folds: int = 3, text: str = "text",
          doc_id: str = "doc_id", max_rows: int = MAX_ROWS, max_terms: int = MAX_TERMS) -> Chain:
    """Fit a chain (``band_1``, ..., ``label``) on a bounded sample of the labelled rows.

    Without labelled rows, or without toxic ones, every probability is near the share of toxic rows (0 if there are none).
    """
    lean(docs.sparkSession)
    sample = stored(_sample(docs, labels, label, text, doc_id, max_rows), "sample")
    vocabulary = _vocabulary(sample, max_terms)
    chain = Chain(vocabulary, [f"band_{b + 1}" for b in range(bands)] + [label])

    @F.pandas_udf("array<int>")
    def present(texts: pd.Series) -> pd.Series:
        return pd.Series([np.nonzero(r)[0].astype(np.int32) for r in chain.matrix(texts.tolist())])
    rows = sample.select(present("__text").alias("x"), "y", F.pmod(F.xxhash64("__id", F.lit(11)), F.lit(folds)).alias("fold"),
                         "__id").orderBy("__id").collect()  # at most max_rows rows of at most max_terms numbers
    x = np.zeros((len(rows), len(vocabulary) + 1))
    for i, r in enumerate(rows):
        x[i, r.x] = 1
    y = np.array([r.y for r in rows])
    cuts = np.linspace(0, min(len(vocabulary), 60), bands + 1).astype(int) + 1
    of_band = [y * (x[:, a:b].max(1, initial=0)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    chain.coefficients = fit_chain(x, np.column_stack([*of_band, y]), np.array([r.fold for r in rows]))
    return chain


def score(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """``docs`` with ``p_<category>`` for each category and ``is_toxic``, whether the last is above the threshold.

    Columns of ``docs`` by these names are replaced.  Null and empty texts have the bias alone.
    """
    lean(docs.sparkSession)
    names = [f"p_{c}" for c in chain.categories]
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # at most max_terms terms

    @F.pandas_udf("array<double>")
    def column(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for texts in batches:
            values = texts.tolist()
            parts = [model.predict(values[a:a + 512]) for a in range(0, len(values), 512)]
            yield pd.Series([row for p in parts for row in p], dtype=object)
        give_back()
    base = docs.drop(*names, "is_toxic", "__p").withColumn("__p", column(F.col(text)))
    return base.withColumns({n: F.col("__p")[i] for i, n in enumerate(names)}).withColumn(
        "is_toxic", F.col(names[-1]) > chain.threshold).drop("__p")


def not_toxic(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the chain does not call toxic, with their own columns only."""
    names = [f"__{i}" for i in range(len(docs.columns))]
    scored = score(docs.toDF(*names), chain, names[docs.columns.index(text)])
    return scored.filter(~F.col("is_toxic")).select(*names).toDF(*docs.columns)
