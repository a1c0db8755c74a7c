"""Linear forecasters from cross-products.

A least-squares fit needs only sums of products of the columns.
Training sets of a rolling origin are nested, so the rows are reduced once to
sums per series and block of days (``cross_products``, on the executors, with
map-side combine); every fold is then fitted
from running sums of a few blocks.  The number of fits does not change how often
the data is read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.feature import PolynomialExpansion, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.windows import by_day
from larder.operators.features import EXOG, LAGGED_EXOG, exog_fill_train_mean
from larder.operators.splits import SEASON, WARMUP, fold_number, forecast_days
from larder.session import spread


def cross_products(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Per group: row count and sums of all columns and of all their pairwise products, as one array.

    Rows with a missing value are skipped.
    """
    vectors = VectorAssembler(inputCols=columns, outputCol="_z", handleInvalid="skip").transform(
        df.dropna(how="any", subset=columns))
    pairs = PolynomialExpansion(degree=2, inputCol="_z", outputCol="_zz").transform(vectors)
    return pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), Summarizer.sum(F.col("_zz")).alias("_sum")).select(
        *keys, "rows", vector_to_array("_sum").alias("products"))


def moments(rows: np.ndarray, products: np.ndarray, width: int) -> np.ndarray:
    """Matrices of sums of products with the constant first: (..., width + 1, width + 1).

    The expansion of (x1 .. xk) lists, for every k, xk and then xk times each of
    x1 .. xk, where the products with xk come after those of earlier columns.
    """
    out = np.zeros((*rows.shape, width + 1, width + 1))
    out[..., 0, 0] = rows
    at = 0
    for j in range(1, width + 1):
        for i in range(j + 1):
            out[..., i, j] = out[..., j, i] = products[..., at]
            at += 1
    return out


class Sums:
    """Running sums of one series' blocks: the moments of the rows before a day."""

    def __init__(self, blocks: pd.DataFrame, starts: np.ndarray, width: int):
        """``starts`` are the first days of the blocks; ``block`` numbers them from 0."""
        self.starts = starts
        products = np.zeros((len(starts), width * (width + 3) // 2))
        rows = np.zeros(len(starts))
        at = blocks["block"].to_numpy(int)
        products[at] = np.vstack(blocks["products"].to_numpy())
        rows[at] = blocks["rows"].to_numpy(float)
        total = np.cumsum(moments(rows, products, width), axis=0)
        self.prefix = np.concatenate([np.zeros((1, *total.shape[1:])), total])

    def before(self, day: int) -> np.ndarray:
        """Moments of the rows before a day that starts a block."""
        return self.prefix[np.searchsorted(self.starts, day)]


def centred(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Covariances and means of the columns from a moment matrix (population)."""
    n = max(m[0, 0], 1.0)
    mean = m[0, 1:] / n
    return m[1:, 1:] / n - np.outer(mean, mean), mean


def fit_least_squares(sums: Sums, first: int, ends: list[int]) -> list[dict]:
    """Ordinary least squares on each slice [first, end); a column without variation gets 0."""
    fits = []
    for end in ends:
        cov, mean = centred(sums.before(end) - sums.before(first))
        sd = np.sqrt(np.maximum(np.diag(cov)[:-1], 0.0))
        live = sd > 1e-9 * (1.0 + np.abs(mean[:-1]))
        scale = np.where(live, sd, 1.0)
        corr = cov[:-1, :-1] / np.outer(scale, scale) * np.outer(live, live)
        b = np.linalg.lstsq(corr, cov[:-1, -1] / scale * live, rcond=1e-10)[0] / scale
        fits.append({"coef": b, "intercept": float(mean[-1] - b @ mean[:-1])})
    return fits


FIT_SCHEMA = "series_id string, candidate string, fold int, intercept double, coef array<double>"


def block_starts_sql(refit_every: int) -> str:
    """First days of a series' blocks, from its ``t0`` and ``n``: every fold start."""
    ends = f"transform(sequence(0, CAST((n - 1 - t0) DIV {refit_every} AS int)), f -> CAST(t0 + f * {refit_every} AS int))"
    return f"array_sort(array_distinct(concat(array(0, {WARMUP}), {ends})))"


def fold_fits(prepared: DataFrame, split: DataFrame, columns: list[str], refit_every: int,
              fit: Callable[[Sums, int, list[int]], list[dict]]) -> DataFrame:
    """Coefficients per series, candidate and fold.

    ``prepared`` has ``series_id, candidate, t`` and the columns, target last; ``split``
    has ``series_id, n, t0``.  Blocks are numbered by the edges each series needs.
    """
    cuts = split.select("series_id", "t0", "n", F.expr(block_starts_sql(refit_every)).alias("starts"))
    train = prepared.select("series_id", "candidate", "t", *columns).join(cuts, "series_id").filter((F.col("t") >= WARMUP) & (F.col("t") < F.col("n")))
    numbered = train.withColumn("block", F.expr("size(filter(starts, e -> e <= t)) - 1"))
    blocks = cross_products(numbered, columns, ["series_id", "candidate", "block"]).join(cuts, "series_id")

    def per_series(pdf: pd.DataFrame) -> pd.DataFrame:
        t0, n = int(pdf["t0"].iloc[0]), int(pdf["n"].iloc[0])
        sums = Sums(pdf, np.asarray(pdf["starts"].iloc[0]), len(columns))
        rows = []
        for fold, f in enumerate(fit(sums, WARMUP, list(range(t0, n, refit_every)))):
            rows.append((pdf["series_id"].iloc[0], pdf["candidate"].iloc[0], fold, f["intercept"], f["coef"]))
        return pd.DataFrame(rows, columns=["series_id", "candidate", "fold", "intercept", "coef"])

    return spread(blocks, "series_id", "candidate", keyed=prepared).groupBy("series_id", "candidate").applyInPandas(
        per_series, FIT_SCHEMA)


def dot(coef: str, columns: list[str]) -> Column:
    """Sum of coefficient times column; NULL if a column is missing."""
    return F.expr(" + ".join(f"{coef}[{i}] * `{c}`" for i, c in enumerate(columns)))


# -- autoregression with drivers --------------------------------------------------------------

# Candidate (order, seasonal order); the first is the default.
ORDERS = [
    ((1, 1, 1), (1, 0, 1, 7)),
    ((0, 1, 1), (0, 0, 1, 7)),
    ((1, 1, 0), (1, 0, 0, 7)),
    ((2, 1, 1), (1, 0, 1, 7)),
    ((1, 1, 2), (1, 0, 1, 7)),
    ((1, 1, 1), (0, 0, 1, 7)),
    ((1, 1, 1), (1, 0, 0, 7)),
    ((2, 1, 2), (1, 0, 1, 7)),
    ((1, 0, 1), (1, 1, 1, 7)),
    ((0, 1, 1), (0, 1, 1, 7)),
]
DEFAULT_ORDER = ORDERS[0]


def _widths(orders: list) -> tuple[int, int]:
    """Most daily and weekly lags that any of the orders needs."""
    return max(o[0] + o[2] for o, _ in orders), max(s[0] + s[2] for _, s in orders)


def _lag_columns(orders: list) -> list[str]:
    daily, weekly = _widths(orders)
    return [f"_w{i}" for i in range(1, daily + 1)] + [f"_s{i}" for i in range(1, weekly + 1)]


def order_name(order: tuple, seasonal: tuple) -> str:
    return f"{order}x{seasonal}".replace(" ", "")


def _candidate(order: tuple, seasonal: tuple, widths: tuple[int, int]) -> Column:
    """One row's regression for a candidate: differenced target, base to add back, lagged terms.

    The series is differenced by day (d = 1) and by week (D = 1).  A long
    autoregression stands in for the moving-average terms: p + q daily lags and
    P + Q weekly lags; unused ones are 0.
    """
    (p, d, q), (sp, sd, sq, _) = order, seasonal
    diff, short, weekly = f"{d}{sd}", p + q, sp + sq
    lag = lambda k: F.col(f"_d{diff}_{k}")
    zero = F.lit(0.0)
    cells = [F.lit(order_name(order, seasonal)).alias("candidate"), lag(0).alias("_target"),
             F.col(f"_b{diff}").alias("_base")]
    cells += [(lag(i) if i <= short else zero).alias(f"_w{i}") for i in range(1, widths[0] + 1)]
    cells += [(lag(SEASON * i) if i <= weekly else zero).alias(f"_s{i}") for i in range(1, widths[1] + 1)]
    return F.struct(*cells)


def _with_differences(df: DataFrame, orders: list) -> DataFrame:
    """Differences of each needed kind and their lags, from the shared day-ordered window."""
    y = lambda k: F.lag("y", k).over(by_day()) if k else F.col("y")
    kinds = sorted({f"{o[1]}{s[1]}" for o, s in orders})
    bases = {"10": y(1), "01": y(SEASON), "11": y(1) + y(SEASON) - y(SEASON + 1), "00": F.lit(0.0)}
    df = df.withColumns({f"_b{k}": bases[k] for k in kinds})
    df = df.withColumns({f"_d{k}_0": F.col("y") - F.col(f"_b{k}") for k in kinds})
    daily, weekly = _widths(orders)
    lags = sorted({*range(1, daily + 1), *(SEASON * i for i in range(1, weekly + 1))})
    return df.withColumns({f"_d{k}_{i}": F.lag(f"_d{k}_0", i).over(by_day()) for k in kinds for i in lags})


def arx(features: DataFrame, split: DataFrame, refit_every: int = 28, orders: list | None = None,
        name: str | None = "arx", only: DataFrame | None = None) -> DataFrame:
    """Test-block forecasts of an autoregression on differenced demand and four drivers.

    Coefficients are estimated anew every ``refit_every`` days; in between the
    lags roll on with the actual values.  Drivers' leading gaps take the mean of
    the rows before the test block, and scaling is part of the fit, so nothing
    looks ahead.  Several ``orders`` become several models, from one job; ``only``
    (``series_id, candidate``) says which series needs which of them.
    """
    wanted = orders or [DEFAULT_ORDER]
    if any(s[3] != SEASON for _, s in wanted):
        raise ValueError(f"the seasonal period must be {SEASON}")
    joined = features.select("series_id", "date", "t", "y", *EXOG).join(split, "series_id").filter(F.col("t") < F.col("n"))
    filled = exog_fill_train_mean(joined, F.col("t0"), LAGGED_EXOG)
    rows = _with_differences(filled, wanted).select(
        "series_id", "date", "t", "n", "t0", "y", *EXOG,
        F.inline(F.array(*[_candidate(o, s, _widths(wanted)) for o, s in wanted])))
    if only is not None:
        rows = rows.join(only, ["series_id", "candidate"], "left_semi")
    columns = [*_lag_columns(wanted), *EXOG]
    fits = fold_fits(rows, split, [*columns, "_target"], refit_every, fit_least_squares)
    days = forecast_days(rows).withColumn("fold", fold_number(refit_every))
    out = days.join(fits.select("series_id", "candidate", "fold", "intercept", "coef"),
                    ["series_id", "candidate", "fold"])
    label = F.lit(name) if name and len(wanted) == 1 else F.col("candidate")
    return out.select("series_id", "date", label.alias("model"),
                      (F.col("_base") + F.col("intercept") + dot("coef", columns)).alias("forecast"),
                      F.col("y").alias("actual"))
