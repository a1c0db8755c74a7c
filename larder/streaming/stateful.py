"""Per-series state that moves on day by day.

Rows of a series may arrive in any order within the watermark's delay.  They wait
in the state until the watermark has passed their day and are then handled in
day order, so a result does not depend on how the input was cut into batches.
The waiting rows of a series are bounded by the delay.  Of several rows for one day the least by content counts
(missing before known values, as ``rows.rows_by_day`` keeps them), whichever arrives first.  Days without a row are
handled too, just before the next day that has one, so that state always moves by single calendar days.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from larder.operators import ledger, rows, smoothing
from larder.operators.policy import Scenario

EPOCH = dt.date(1970, 1, 1)
DAY_MS = 86_400_000
_STATE = "last_day int, days array<int>, waiting array<double>, numbers array<double>, latest array<double>"


def _content(values: list[float]) -> list[tuple]:
    """What rows of one day are ordered by: column by column, missing first."""
    return [(not np.isnan(v), 0.0 if np.isnan(v) else v) for v in values]


def in_day_order(daily: DataFrame, columns: list[str], step: Callable[[list[float], dt.date, list[float]], tuple],
                 start: list[float], schema: str, delay: str = "2 days", carried: int = 0) -> DataFrame:
    """Apply ``step(numbers, date, values) -> (numbers, output row or None)`` to each series' days in order.

    ``daily`` is a stream with ``series_id, date`` and ``columns``; ``numbers`` is
    the state of one series, ``start`` its first value.  Missing values arrive as NaN.

    A calendar day without a row, between two that have one, is a step of its own: all values are missing, but the last
    ``carried`` columns keep the values of the day before.  It is emitted with the next row of its series, as only that
    row tells a gap from the end of the series.  A gap of more than ``rows.MAX_GAP`` days is not filled: the state
    goes on with the next row.
    """
    width = len(columns)
    names = [f.split()[0] for f in schema.split(", ")]

    def handle(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, days, waiting, numbers, latest = state.get if state.exists else (None, [], [], list(start), [])
        waits = {d: list(waiting[i * width:(i + 1) * width]) for i, d in enumerate(days)}
        if not state.hasTimedOut:
            for pdf in batches:
                for row in pdf.itertuples(index=False):
                    if last is None or row.day > last:
                        new = [float(v) if v is not None else float("nan") for v in row[2:]]
                        old = waits.get(row.day)
                        waits[row.day] = new if old is None else min(old, new, key=_content)
        passed = state.getCurrentWatermarkMs() // DAY_MS
        out = []
        numbers, latest = list(numbers), list(latest)
        for known in sorted(d for d in waits if d < passed):
            gap = last is not None and known - last <= rows.MAX_GAP
            for day in range(last + 1 if gap else known, known + 1):
                latest = waits.pop(day) if day == known else [float("nan")] * (width - carried) + latest[width - carried:]
                date = EPOCH + dt.timedelta(days=int(day))
                numbers, result = step(numbers, date, latest)
                if result is not None:
                    out.append((key[0], date, *result))
            last = int(known)
        left = sorted(waits)
        state.update((None if last is None else int(last), [int(d) for d in left],
                      [float(v) for d in left for v in waits[d]], [float(v) for v in numbers], [float(v) for v in latest]))
        if left:
            state.setTimeoutTimestamp(max((int(left[0]) + 1) * DAY_MS, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=names)

    timed = (daily.withColumn("at", F.timestamp_seconds(F.unix_date("date").cast("bigint") * 86400)).withWatermark("at", delay)
             .select("series_id", F.unix_date("date").alias("day"), *[F.col(c).cast("double") for c in columns], "at"))
    keep = ["series_id", "day", *columns]

    def drop_time(key, batches, state):
        yield from handle(key, (pdf[keep] for pdf in batches), state)

    return timed.groupBy("series_id").applyInPandasWithState(
        drop_time, schema, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


FORECAST_SCHEMA = "series_id string, date date, forecast double, actual double"


def _number(v: float) -> float | None:
    return None if np.isnan(v) else float(v)


def seasonal_naive(daily: DataFrame, delay: str = "2 days", season: int = 7) -> DataFrame:
    """Forecast each day from the same day a season earlier, then learn the day.

    ``daily`` has ``series_id, date, y``.  State: the last ``season`` calendar days.
    """
    def step(numbers: list[float], date: dt.date, values: list[float]):
        day = (date - EPOCH).days
        known = {int(numbers[i]): numbers[i + 1] for i in range(0, len(numbers), 2)}
        forecast = known.get(day - season, float("nan"))
        known[day] = values[0]
        recent = [x for d in sorted(known) if d > day - season for x in (float(d), known[d])]
        return recent, (_number(forecast), _number(values[0]))

    return in_day_order(daily, ["y"], step, [], FORECAST_SCHEMA, delay)


def holt_winters(daily: DataFrame, weights: DataFrame, delay: str = "2 days") -> DataFrame:
    """Smoothing with weights that a batch job renews on a cadence.

    ``weights`` is the versioned table of ``smoothing.holt_winters_weights``; it is
    joined to the stream by series and validity, so a new version takes over on its
    first day (if that day has no row, with the next row).  Days without a version learn with the first weights of the grid and
    emit nothing.  State: the first two weeks, then level, trend and season.
    """
    joined = daily.join(weights.select("series_id", "valid_from", "valid_to", "alpha", "beta", "gamma"), [
        daily["series_id"] == weights["series_id"], daily["date"] >= weights["valid_from"],
        daily["date"] < weights["valid_to"]], "left").select(
            daily["series_id"], daily["date"], "y", "alpha", "beta", "gamma")
    lead = 2 * smoothing.SEASON
    first = smoothing.DEFAULT_VARIANT.weights()[0]

    def columns(values: list[float]) -> tuple:
        chosen = first[:3] if np.isnan(values[1]) else values[1:4]
        return tuple(np.array([[w]]) for w in (*chosen, 1.0))

    def step(numbers: list[float], date: dt.date, values: list[float]):
        t = int(numbers[0])
        y = values[0]
        w = columns(values)
        if t < lead:
            head = [*numbers[1:], y]
            if t + 1 < lead:
                return [t + 1.0, *head], None
            state = smoothing.holt_winters_start(np.array(head)[:, None], 1)
            for i, v in enumerate(head):
                v = smoothing.holt_winters_forecast(state, i, w) if np.isnan(v) else np.array([[v]])
                smoothing.holt_winters_learn(state, i, v, w)
            return _packed(t + 1, state), None
        state = {"level": np.array([[numbers[1]]]), "trend": np.array([[numbers[2]]]),
                 "season": np.array(numbers[3:]).reshape(-1, 1, 1)}
        forecast = smoothing.holt_winters_forecast(state, t, w)
        smoothing.holt_winters_learn(state, t, forecast if np.isnan(y) else np.array([[y]]), w)
        row = None if np.isnan(values[1]) else (float(forecast[0, 0]), _number(y))
        return _packed(t + 1, state), row

    return in_day_order(joined, ["y", "alpha", "beta", "gamma"], step, [0.0], FORECAST_SCHEMA, delay, carried=3)


def _packed(t: int, state: dict) -> list[float]:
    return [float(t), float(state["level"][0, 0]), float(state["trend"][0, 0]), *state["season"][:, 0, 0].tolist()]


STREAM_LEDGER_SCHEMA = (
    "series_id string, date date, demand double, ordered double, arrived_short double, arrived_long double, "
    "expired_short double, expired_long double, courier double, served double, short double, "
    "onhand_short double, onhand_long double")


def stock_ledger(daily: DataFrame, scenario: Scenario = Scenario(), delay: str = "2 days") -> DataFrame:
    """Stock by age per series, moved on by each day's demand; one ledger row per day.

    ``daily`` has ``series_id, date, demand, forecast, mean_daily, sigma_interval``.
    State: units per slot and the orders under way.
    """
    sizes = (scenario.shelf_life, scenario.shelf_life_long, scenario.lead_time)

    def step(numbers: list[float], date: dt.date, values: list[float]):
        demand, forecast, mean, sigma = (np.array([v]) for v in np.nan_to_num(values))
        if numbers:
            edges = np.cumsum(sizes)
            parts = np.split(np.array(numbers)[:, None], edges[:2])
            state = dict(zip(("short", "long", "coming"), parts))
        else:
            state = ledger.opening(mean, scenario)
        row = ledger.stock_day(state, demand, forecast, mean, sigma, scenario)
        packed = np.concatenate([state["short"], state["long"], state["coming"]])[:, 0].tolist()
        return packed, tuple(float(row[c][0]) for c in ledger.LEDGER_NUMBERS)

    return in_day_order(daily, ["demand", "forecast", "mean_daily", "sigma_interval"], step, [],
                        STREAM_LEDGER_SCHEMA, delay, carried=3)
