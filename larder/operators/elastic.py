"""Elastic net over all series: ``pyspark.ml.LinearRegression`` on the pooled training table.

Penalty and ratio are chosen by cross-validation on the rows before the test block, then the model is refitted on
the cadence of the back-test.  Squared errors are sums of products: one pass over the rows reduces every validation split to the
products of its columns, from which every setting is fitted and scored, whatever the number of settings, rows and series.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.operators.features import FEATURES
from larder.operators.splits import WARMUP, with_split
from larder.operators.trees import TreeModel, folds_of, learnable, training_table, tree_forecasts

# Ratios tried.
L1_RATIOS = (0.1, 0.3, 0.5, 0.7, 0.9, 0.95, 1.0)
# Penalties of a falling geometric path and where it ends, as a share of the least penalty that leaves no coefficient.
N_ALPHAS, ALPHA_SPAN = 100, 1e-3
CV_SPLITS = 5
# Coordinate descent ends when no coefficient moves by this share of the label's deviation, or after so many rounds.
TOLERANCE, MOST_ROUNDS = 1e-7, 5000


@dataclass(frozen=True)
class Choice:
    """The chosen setting and the score of every other: ``l1_ratio, alpha, cv_mse, chosen``."""

    model: TreeModel
    settings: list[tuple[float, float, float, int]]


def penalised(alpha: float, l1_ratio: float, label_sd: float, name: str = "elasticnet") -> TreeModel:
    """The learner that minimises  mean((y - xb)^2) / 2 + alpha * (l1_ratio * |b| + (1 - l1_ratio) * b^2 / 2)  for standardised x.

    Spark's learner divides the label by its deviation too, so that its square penalty weighs less by that deviation.
    """
    absolute, square = alpha * l1_ratio, alpha * (1 - l1_ratio) * label_sd
    total = absolute + square
    return TreeModel(name, "linear", {"solver": "normal", "standardization": True, "regParam": total,
                                      "elasticNetParam": absolute / total if total > 0 else 0.0})


def split_number(past_only: bool) -> Column:
    """Validation split of a row before the test block: the last five sixths in order, or five even parts; -1 is never validated."""
    n = F.col("t0") - F.lit(WARMUP)
    if not past_only:
        return F.floor((F.col("t") - WARMUP) * CV_SPLITS / n).cast("int")
    size = F.floor(n / (CV_SPLITS + 1))
    return F.greatest(F.lit(-1), F.floor((F.col("t") - (F.col("t0") - CV_SPLITS * size)) / size)).cast("int")


def _products(rows: DataFrame) -> dict[int, np.ndarray]:
    """By split the sums of products of ``1, x, label``, columns less their means: one pass for the means, one for the products."""
    x = vector_to_array("vec")
    first = rows.agg(*[F.avg(F.get(x, F.lit(i))) for i in range(len(FEATURES))], F.avg("label")).first()
    if first[-1] is None:
        return {}
    means, size = np.array(first), len(FEATURES) + 2

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[int, np.ndarray] = {}
        for pdf in batches:
            for s, part in pdf.groupby("split"):
                z = np.column_stack([np.vstack(part["x"].to_numpy()), part["label"].to_numpy()]) - means
                z = np.column_stack([np.ones(len(z)), z])
                found[s] = found.get(s, 0.0) + z.T @ z
        for s, product in found.items():
            yield pd.DataFrame({"split": s, "at": np.arange(size * size), "s": product.ravel()})
    totals = rows.select("split", x.alias("x"), "label").mapInPandas(sums, "split int, at int, s double").groupBy("split", "at").agg(F.sum("s").alias("s"))
    found: dict[int, np.ndarray] = {}
    for r in totals.collect():  # a number for each split and pair of columns
        found.setdefault(r["split"], np.zeros(size * size))[r["at"]] = r["s"]
    return {s: v.reshape(size, size) for s, v in found.items()}


def _moments(product: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """(means, deviations, correlations, covariances of standard columns with the label, the label's deviation); 0 where nothing varies."""
    mean = product[0, 1:] / product[0, 0]
    second = product[1:, 1:] / product[0, 0]
    cov = second - np.outer(mean, mean)
    var = np.diag(cov)
    sd = np.sqrt(np.where(var > 1e-12 * np.diag(second), var, 0.0))
    inverse = np.divide(1.0, sd, out=np.zeros_like(sd), where=sd > 0)
    x = inverse[:-1]
    return mean, sd, cov[:-1, :-1] * np.outer(x, x), cov[:-1, -1] * x * (sd[-1] > 0), float(sd[-1])


def _descend(corr: np.ndarray, toward: np.ndarray, absolute: float, square: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Coefficients of standard columns, a problem a row: coordinate descent from ``start``."""
    b = start.copy()
    for _ in range(MOST_ROUNDS):
        before = b.copy()
        for j in range(b.shape[1]):
            r = toward[:, j] - np.einsum("ij,ij->i", corr[:, j], b) + corr[:, j, j] * b[:, j]
            b[:, j] = np.sign(r) * np.maximum(np.abs(r) - absolute, 0.0) / (1.0 + square)
        if (np.abs(b - before).max(axis=1) <= stop).all():
            break
    return b


def _errors(trains: list[np.ndarray], helds: list[np.ndarray], largest: float, label_sd: float, ratios: tuple[float, ...],
            shares: np.ndarray) -> np.ndarray:
    """Mean squared error by split, ratio and penalty: fits on ``trains``, from the largest penalty down, judged on ``helds``."""
    moments = [_moments(p) for p in trains]
    each = [(k, r) for k in range(len(trains)) for r in ratios]
    mean, sd, corr, toward = (np.array([moments[k][i] for k, _ in each]) for i in range(4))
    own = np.array([moments[k][4] for k, _ in each])
    held = np.array([helds[k] / helds[k][0, 0] for k, _ in each])
    ratio = np.array([r for _, r in each])
    b, out = np.zeros(toward.shape), []
    for share in shares:
        alpha = largest / ratio * share
        square = np.divide(alpha * (1 - ratio) * label_sd, own, out=np.zeros_like(own), where=own > 0)
        b = _descend(corr, toward, largest * share, square, b, TOLERANCE * own)
        plain = np.divide(b, sd[:, :-1], out=np.zeros_like(b), where=sd[:, :-1] > 0)
        bias = mean[:, -1] - np.einsum("ij,ij->i", mean[:, :-1], plain)
        rest = np.column_stack([-bias, -plain, np.ones(len(b))])
        out.append(np.einsum("ij,ijk,ik->i", rest, held, rest))
    return np.array(out).T.reshape(len(trains), len(ratios), len(shares))


def choose(table: DataFrame, past_only: bool = True, n_alphas: int = N_ALPHAS, ratios: tuple[float, ...] = L1_RATIOS,
           name: str = "elasticnet") -> Choice:
    """Penalty and ratio with the least mean validation error on the rows before the test block; ties go to the larger penalty.

    With ``past_only`` a split is judged by a fit on earlier rows, otherwise on all other rows.  Without rows, or where the
    label does not vary, the penalty is 0 and the settings are empty.
    """
    rows = learnable(table).filter((F.col("t") >= WARMUP) & (F.col("t") < F.col("t0"))).withColumn("split", split_number(past_only))
    products = _products(rows)
    if not products:
        return Choice(penalised(0.0, 1.0, 1.0, name), [])
    *_, toward, label_sd = _moments(sum(products.values()))
    largest = float(np.abs(toward).max())

    def learned_from(s: int) -> np.ndarray:
        return sum((p for k, p in products.items() if (k < s if past_only else k != s)), np.zeros_like(products[s]))
    splits = [s for s in range(CV_SPLITS) if s in products and learned_from(s)[0, 0] > 1]
    if not largest or not splits:
        return Choice(penalised(0.0, 1.0, 1.0, name), [])
    shares = np.logspace(0, np.log10(ALPHA_SPAN), n_alphas)
    settings = [(r, largest / r * a) for r in ratios for a in shares]
    errors = _errors([learned_from(s) for s in splits], [products[s] for s in splits], largest, label_sd, ratios, shares)
    mean = [float(v) for v in errors.mean(axis=0).ravel()]
    best = min(range(len(settings)), key=lambda i: (round(mean[i], 12), -settings[i][1]))
    ratio, alpha = settings[best]
    return Choice(penalised(alpha, ratio, label_sd, name),
                  [(r, float(a), m, int(i == best)) for i, ((r, a), m) in enumerate(zip(settings, mean, strict=True))])


def elastic_net(features: DataFrame, split: DataFrame, refit_every: int = 14, past_only: bool = True, n_alphas: int = N_ALPHAS,
                name: str = "elasticnet", table: DataFrame | None = None) -> DataFrame:
    """Test-block forecasts; ``table`` is the pooled training table if there is one already."""
    table = table or training_table(with_split(features, split))
    chosen = choose(table, past_only, n_alphas, name=name)
    return tree_forecasts(table, [chosen.model], refit_every, folds_of(split, refit_every))


def settings_table(table: DataFrame, choice: Choice) -> DataFrame:
    return table.sparkSession.createDataFrame(choice.settings, "l1_ratio double, alpha double, cv_mse double, chosen int")


def standard_coefficients(table: DataFrame, choice: Choice) -> DataFrame:
    """``name, value``: signed coefficients per deviation of each feature, of one model of all rows before the test block."""
    rows = learnable(table).filter((F.col("t") >= WARMUP) & (F.col("t") < F.col("t0"))).select("vec", "label")
    fitted = choice.model.estimator().fit(rows)
    x = vector_to_array("vec")
    sd = rows.agg(*[F.stddev_pop(F.get(x, F.lit(i))).alias(c) for i, c in enumerate(FEATURES)]).first()
    values = [(c, float(b * (sd[c] or 0.0))) for c, b in zip(FEATURES, fitted.coefficients.toArray(), strict=True)]
    return table.sparkSession.createDataFrame(values, "name string, value double")
