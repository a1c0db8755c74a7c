"""Exponential smoothing and Theta forecasts, one step ahead.

The smoothing recurrences run over series in numpy lanes (``operators.lanes``),
with one lane per weight setting beside them, so choosing weights costs no
second pass: every setting's errors are known on every day, and a refit is a
look-up of the smallest past error sum.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators.lanes import as_arrays, padded, run_lanes

SEASON = 7
LONG_SCHEMA = "series_id string, date date, model string, forecast double, actual double"
# Smoothing weights tried for level, trend, season and damping.
LEVEL_WEIGHTS = (0.05, 0.1, 0.2, 0.3, 0.5)
TREND_WEIGHTS = (0.0, 0.01, 0.05)
SEASON_WEIGHTS = (0.01, 0.05, 0.1, 0.2)
DAMPING = (0.8, 0.9, 0.98)


@dataclass(frozen=True)
class Variant:
    """Form of the Holt-Winters model."""

    trend: bool = True
    multiplicative: bool = False
    damped: bool = False

    @property
    def name(self) -> str:
        trend = ("damped" if self.damped else "add") if self.trend else "none"
        return f"trend={trend},season={'mul' if self.multiplicative else 'add'}"

    def weights(self) -> list[tuple[float, float, float, float]]:
        """(level, trend, season, damping) settings to try."""
        return list(product(LEVEL_WEIGHTS, TREND_WEIGHTS if self.trend else (0.0,), SEASON_WEIGHTS,
                            DAMPING if self.damped else (1.0,)))


DEFAULT_VARIANT = Variant()


def holt_winters_days(y: np.ndarray, weights: list[tuple[float, float, float, float]],
                      variant: Variant = DEFAULT_VARIANT) -> np.ndarray:
    """Forecast of every day from the days before it: (days, lanes) -> (days, lanes, settings).

    Starts from the first two weeks: their mean difference is the trend, the first
    week's mean the level, the distance of each of its days from that the season.
    On a day without a value the model believes its own forecast.
    """
    days, lanes = y.shape
    columns = tuple(np.array(w)[None, :] for w in zip(*weights))
    state = holt_winters_start(y[:2 * SEASON], len(weights), variant)
    out = np.full((days, lanes, len(weights)), np.nan)
    for t in range(days):
        out[t] = holt_winters_forecast(state, t, columns, variant)
        value = np.where(np.isnan(y[t])[:, None], out[t], y[t][:, None])
        holt_winters_learn(state, t, value, columns, variant)
    return out


def holt_winters_start(head: np.ndarray, settings: int, variant: Variant = DEFAULT_VARIANT) -> dict:
    """Level, trend and season per lane and setting from the first two weeks (days, lanes)."""
    filled = np.where(np.isnan(head), _mean(head), head)
    level = filled[:SEASON].mean(axis=0)
    enough = variant.trend and len(head) >= 2 * SEASON
    trend = (filled[SEASON:].mean(axis=0) - level) / SEASON if enough else np.zeros(head.shape[1])
    week = filled[:SEASON]
    season = week / np.where(level == 0, 1.0, level) if variant.multiplicative else week - level
    return {"level": np.repeat(level[:, None], settings, axis=1), "trend": np.repeat(trend[:, None], settings, axis=1),
            "season": np.repeat(season[:, :, None], settings, axis=2)}


def holt_winters_forecast(state: dict, t: int, weights: tuple, variant: Variant = DEFAULT_VARIANT) -> np.ndarray:
    base = state["level"] + weights[3] * state["trend"]
    season = state["season"][t % SEASON]
    return base * season if variant.multiplicative else base + season


def holt_winters_learn(state: dict, t: int, value: np.ndarray, weights: tuple,
                       variant: Variant = DEFAULT_VARIANT) -> None:
    """Move level, trend and season on by one day's value."""
    alpha, beta, gamma, phi = weights
    season = state["season"][t % SEASON]
    base = state["level"] + phi * state["trend"]
    without_season = _ratio(value, season) if variant.multiplicative else value - season
    level = alpha * without_season + (1 - alpha) * base
    state["trend"] = beta * (level - state["level"]) + (1 - beta) * phi * state["trend"]
    without_level = _ratio(value, base) if variant.multiplicative else value - base
    state["season"][t % SEASON] = gamma * without_level + (1 - gamma) * season
    state["level"] = level


def _mean(a: np.ndarray) -> np.ndarray:
    """Column means over the present values, 0 where there is none."""
    n = (~np.isnan(a)).sum(axis=0)
    return np.nansum(a, axis=0) / np.maximum(n, 1)


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    safe = np.abs(b) > 1e-9
    return np.where(safe, a / np.where(safe, b, 1.0), 1.0)


def past_squares(y: np.ndarray, forecasts: np.ndarray) -> np.ndarray:
    """Sum of squared errors of each setting over the days before each day."""
    squares = np.nan_to_num((y[:, :, None] - forecasts) ** 2)
    # The first weeks set the starting values; their errors do not judge the weights.
    squares[:2 * SEASON] = 0.0
    total = np.cumsum(squares, axis=0)
    return np.concatenate([np.zeros((1, *total.shape[1:])), total[:-1]])


def _long(rows: pd.DataFrame, y: np.ndarray, chosen: np.ndarray, model: str) -> pd.DataFrame:
    """Forecasts of the test days as long rows; ``chosen`` is (days, lanes)."""
    day = np.arange(y.shape[0])[:, None]
    inside = ((day >= rows["t0"].to_numpy()[None, :]) & (day < rows["n"].to_numpy()[None, :])).T
    lane, t = np.nonzero(inside)
    dates = [np.asarray(d) for d in rows["date"]]
    return pd.DataFrame({
        "series_id": rows["series_id"].to_numpy()[lane],
        "date": [dates[k][i] for k, i in zip(lane, t)],
        "model": model, "forecast": chosen.T[inside], "actual": y.T[inside]})


def _arrays(features: DataFrame, split: DataFrame) -> DataFrame:
    joined = features.select("series_id", "date", "t", "y").join(split, "series_id").filter(F.col("t") < F.col("n"))
    return as_arrays(joined, ["y"], keep=["n", "t0"])


def holt_winters_fixed(features: DataFrame, level: float, trend: float, season: float, damping: float = 1.0,
                       variant: Variant = DEFAULT_VARIANT) -> DataFrame:
    """Every day's one-step forecast with given weights."""
    counts = features.groupBy("series_id").agg(F.count(F.lit(1)).alias("n")).withColumn("t0", F.lit(0).cast("bigint"))

    def step(rows: pd.DataFrame, longest: int) -> pd.DataFrame:
        y = padded(rows["y"], longest)
        return _long(rows, y, holt_winters_days(y, [(level, trend, season, damping)], variant)[:, :, 0], "holt_winters")

    return run_lanes(_arrays(features, counts), step, LONG_SCHEMA, values_per_day=4)


def holt_winters(features: DataFrame, split: DataFrame, refit_every: int = 14,
                 variants: list[Variant] | None = None, name: str | None = "holt_winters") -> DataFrame:
    """Test-block forecasts; weights are chosen anew every ``refit_every`` days on the days before.

    With several ``variants`` each becomes a model of its own, from one job; a
    multiplicative one is left out for a series that has a value of 0 or less before its test block.
    ``name`` labels a single variant, otherwise its own name is used.
    """
    forms = variants or [DEFAULT_VARIANT]

    def step(rows: pd.DataFrame, longest: int) -> pd.DataFrame:
        y = padded(rows["y"], longest)
        t0 = rows["t0"].to_numpy(int)
        refit_day = t0 + np.maximum(np.arange(longest)[:, None] - t0, 0) // refit_every * refit_every
        parts = []
        for form in forms:
            lanes = np.arange(len(rows))
            if form.multiplicative:
                past = np.arange(longest)[:, None] < t0
                lanes = np.flatnonzero(~((y <= 0) & past).any(axis=0))
            if not len(lanes):
                continue
            yy = y[:, lanes]
            forecasts = holt_winters_days(yy, form.weights(), form)
            at = np.minimum(refit_day[:, lanes], longest - 1)
            best = np.argmin(past_squares(yy, forecasts), axis=2)[at, np.arange(len(lanes))]
            chosen = np.take_along_axis(forecasts, best[:, :, None], axis=2)[:, :, 0]
            label = name if name and len(forms) == 1 else form.name
            parts.append(_long(rows.iloc[lanes].reset_index(drop=True), yy, chosen, label))
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame()

    widest = max(len(f.weights()) for f in forms)
    return run_lanes(_arrays(features, split), step, LONG_SCHEMA, values_per_day=3 * widest)


def holt_winters_weights(features: DataFrame, split: DataFrame, refit_every: int = 14) -> DataFrame:
    """Versioned weights: per series and refit day the setting with the smallest past error.

    ``series_id, version, valid_from, valid_to, alpha, beta, gamma``; a version holds on the
    days from ``valid_from`` up to, not including, ``valid_to``.
    """
    grid = DEFAULT_VARIANT.weights()

    def step(rows: pd.DataFrame, longest: int) -> pd.DataFrame:
        y = padded(rows["y"], longest)
        best = np.argmin(past_squares(y, holt_winters_days(y, grid)), axis=2)
        out = []
        for k, row in rows.iterrows():
            first = pd.Timestamp(np.asarray(row["date"])[0])
            for version, day in enumerate(range(int(row["t0"]), int(row["n"]), refit_every)):
                until = min(day + refit_every, int(row["n"]))
                out.append((row["series_id"], version, (first + pd.Timedelta(days=day)).date(),
                            (first + pd.Timedelta(days=until)).date(), *grid[best[day, k]][:3]))
        return pd.DataFrame(out, columns=["series_id", "version", "valid_from", "valid_to", "alpha", "beta", "gamma"])

    schema = ("series_id string, version int, valid_from date, valid_to date, alpha double, beta double, gamma double")
    return run_lanes(_arrays(features, split), step, schema, values_per_day=3 * len(grid))


# -- Theta --------------------------------------------------------------------------------------

THETA_LEVELS = (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8)


@dataclass(frozen=True)
class ThetaForm:
    """Seasonal treatment: ``auto`` is multiplicative while every value so far is above 0."""

    deseasonalize: bool = True
    method: str = "auto"

    @property
    def name(self) -> str:
        return f"deseasonalize={str(self.deseasonalize).lower()},method={self.method}"


DEFAULT_THETA = ThetaForm()


def theta_days(y: np.ndarray, form: ThetaForm = DEFAULT_THETA) -> np.ndarray:
    """Forecast of every day from the days before it: (days, lanes) -> (days, lanes, level weights).

    Season: means per weekday position so far, against the mean so far.  Long run:
    half the slope so far.  Short run: the smoothed, season-free level.  Smoothing
    is linear, so the level of the season-free series is put together from
    smoothed weekday parts and the season as known on the day; each day is a full
    refit without going over the history again.
    """
    days, lanes = y.shape
    t = np.arange(days, dtype=float)[:, None]
    seen = ~np.isnan(y)
    value = np.where(seen, y, 0.0)
    before = lambda a: np.concatenate([np.zeros((1, *a.shape[1:])), np.cumsum(a, axis=0)[:-1]])
    n, sy, st, stt, sty = (before(a) for a in (seen * 1.0, value, seen * t, seen * t * t, value * t))
    mean = sy / np.maximum(n, 1)
    spread = n * stt - st * st
    slope = np.where(spread > 0, (n * sty - st * sy) / np.where(spread > 0, spread, 1.0), 0.0)

    weekday = (np.arange(days) % SEASON)[:, None] == np.arange(SEASON)[None, :]
    wn = before(seen[:, :, None] * weekday[:, None, :] * 1.0)
    ws = before(value[:, :, None] * weekday[:, None, :])
    wmean = np.where(wn > 0, ws / np.maximum(wn, 1), mean[:, :, None])
    positive = before(((y <= 0) & seen) * 1.0) == 0
    multiplicative = positive if form.method == "auto" else np.full((days, lanes), form.method == "multiplicative")
    multiplicative = multiplicative & (mean > 0) & (wmean > 0).all(axis=2)
    if not form.deseasonalize:
        multiplicative = np.zeros((days, lanes), bool)
    ratio = np.where(multiplicative[:, :, None], wmean / np.where(mean > 0, mean, 1.0)[:, :, None], 1.0)
    ratio = np.where(ratio > 1e-9, ratio, 1.0)
    shift = np.where(multiplicative[:, :, None] | (not form.deseasonalize), 0.0, wmean - mean[:, :, None])

    alpha = np.array(THETA_LEVELS)
    level_y = np.zeros((lanes, alpha.size, SEASON))   # smoothed value, by weekday part
    level_1 = np.zeros((lanes, alpha.size, SEASON))   # smoothed weekday indicator
    out = np.full((days, lanes, alpha.size), np.nan)
    for d in range(days):
        level = (level_y / ratio[d][:, None, :] - level_1 * shift[d][:, None, :]).sum(axis=2)
        grow = (1.0 - (1.0 - alpha[None, :]) ** n[d][:, None]) / alpha[None, :]
        plain = level + 0.5 * slope[d][:, None] * grow
        k = d % SEASON
        out[d] = plain * ratio[d][:, k, None] + shift[d][:, k, None]
        here = seen[d]
        if d == 0 or not here.all():
            weight = np.where(n[d][:, None] == 0, 1.0, alpha[None, :]) * here[:, None]
        else:
            weight = np.broadcast_to(alpha[None, :], (lanes, alpha.size))
        level_y *= (1.0 - weight)[:, :, None]
        level_1 *= (1.0 - weight)[:, :, None]
        level_y[:, :, k] += weight * value[d][:, None]
        level_1[:, :, k] += weight
    return out


def theta(features: DataFrame, split: DataFrame, forms: list[ThetaForm] | None = None,
          name: str | None = "theta") -> DataFrame:
    """Test-block forecasts, refitted daily; the level weight is the one with the smallest past error."""
    wanted = forms or [DEFAULT_THETA]

    def step(rows: pd.DataFrame, longest: int) -> pd.DataFrame:
        y = padded(rows["y"], longest)
        parts = []
        for form in wanted:
            forecasts = theta_days(y, form)
            best = np.argmin(past_squares(y, forecasts), axis=2)
            chosen = np.take_along_axis(forecasts, best[:, :, None], axis=2)[:, :, 0]
            label = name if name and len(wanted) == 1 else form.name
            parts.append(_long(rows, y, chosen, label))
        return pd.concat(parts, ignore_index=True)

    return run_lanes(_arrays(features, split), step, LONG_SCHEMA, values_per_day=12 * SEASON + 3 * len(THETA_LEVELS))
