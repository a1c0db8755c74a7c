"""Ordering policy and the parts of one stock day, as column expressions.

Each part works on a row of a (series, date) table, so none of them shuffles
beyond the windows of the daily table.  ``operators.ledger`` runs them in day
order with feedback.
"""

from __future__ import annotations

from dataclasses import dataclass
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.columns import half_even, sum_columns
from larder.functions.windows import ahead, by_day, day_number, whole
from larder.schema import stock_columns_in


@dataclass(frozen=True)
class Scenario:
    """Settings of one policy run."""

    name: str = "default"
    service_level: float = 0.95
    frac_long: float = 0.05
    lead_time: int = 2
    review: int = 1
    shelf_life: int = 5
    shelf_life_long: int = 7
    safety_floor: int = 10
    max_cover_days: float | None = None

    def __post_init__(self):
        if self.lead_time < 1:
            raise ValueError("lead_time must be at least 1 day")
        if not 0.0 <= self.frac_long <= 1.0:
            raise ValueError("frac_long must lie between 0 and 1")

    @property
    def z(self) -> float:
        return NormalDist().inv_cdf(self.service_level)

    @property
    def horizon(self) -> int:
        return self.lead_time + self.review

    @property
    def cover_cap(self) -> float:
        """Days of demand the target may cover: the blended shelf life unless set."""
        if self.max_cover_days is not None:
            return float(self.max_cover_days)
        return self.shelf_life * (1.0 - self.frac_long) + self.shelf_life_long * self.frac_long


def with_scenarios(df: DataFrame, scenarios: list[Scenario]) -> DataFrame:
    """Every row once per scenario, with its settings beside it.

    The settings are literals of the plan, so rows are repeated where they are:
    no join, no shuffle.
    """
    rows = F.array(*[F.struct(
        F.lit(s.name).alias("scenario"), F.lit(float(s.service_level)).alias("service_level"), F.lit(s.z).alias("z"),
        F.lit(float(s.frac_long)).alias("frac_long"), F.lit(s.lead_time).alias("lead_time"),
        F.lit(s.review).alias("review"), F.lit(s.shelf_life).alias("shelf_life"),
        F.lit(s.shelf_life_long).alias("shelf_life_long"), F.lit(s.safety_floor).alias("safety_floor"),
        F.lit(s.cover_cap).alias("cover_cap")) for s in scenarios])
    return df.select("*", F.inline(rows))


def service_level_scenarios(levels: tuple[float, ...] = (0.90, 0.95, 0.98, 0.99)) -> list[Scenario]:
    return [Scenario(f"service_{level:.2f}", service_level=level) for level in levels]


def mix_scenarios(fracs: tuple[float, ...] = (0.0, 0.05, 0.10, 0.15, 0.20, 0.25, 0.30)) -> list[Scenario]:
    return [Scenario(f"long_{frac:.2f}", frac_long=frac) for frac in fracs]


def blended_cover_cap(shelf_life: Column, shelf_life_long: Column, frac_long: Column) -> Column:
    return shelf_life * (F.lit(1.0) - frac_long) + shelf_life_long * frac_long


def safety_stock(z: Column, horizon: Column, sigma_1step: Column | None = None,
                 sigma_interval: Column | None = None) -> Column:
    """Buffer from the measured interval error, or from the one-day error scaled to the interval."""
    if sigma_interval is not None:
        return z * sigma_interval
    if sigma_1step is None:
        raise ValueError("pass sigma_1step or sigma_interval")
    return z * sigma_1step * F.sqrt(horizon)


def order_up_to_level(forecast_sum: Column, safety: Column, mean_daily: Column | None = None,
                      cover_days: Column | None = None) -> Column:
    """Target level, capped at ``cover_days`` of mean demand unless the mean is 0 or unknown."""
    level = forecast_sum + safety
    if mean_daily is None or cover_days is None:
        return level
    # least() skips NULL: an unknown level must stay unknown
    capped = F.when(level.isNotNull(), F.least(level, cover_days * mean_daily))
    return F.when(mean_daily.isNull() | (mean_daily == 0), level).otherwise(capped)


def order_quantity(level: Column, position: Column) -> Column:
    """Units to order, never below 0; NULL where level or position is unknown."""
    wanted = half_even(level - position)
    return F.when(wanted.isNotNull(), F.greatest(F.lit(0.0), wanted))


def interval_error_std(df: DataFrame, horizon: int, demand: str = "demand", forecast: str = "forecast") -> DataFrame:
    """Per series: deviation of demand over the next ``horizon`` days from ``horizon`` x forecast.

    Only whole intervals count: every one of the days has a demand, and there is a forecast.
    """
    nearest = F.count(demand).over(ahead(horizon))
    numbered = df.select(
        "series_id",
        F.when(nearest == horizon, F.sum(demand).over(ahead(horizon)) - horizon * F.col(forecast)).alias("_error"),
        day_number().alias("_t"), F.count(F.lit(1)).over(whole()).alias("_n"))
    return (numbered.filter(F.col("_t") < F.col("_n") - horizon)
            .groupBy("series_id").agg(F.stddev_pop("_error").alias("sigma_interval")))


def fallback_forecast(clean: DataFrame) -> DataFrame:
    """Trailing mean as forecast, the series mean where there is no past."""
    mean = F.avg("demand_model").over(whole())
    return clean.select(
        "series_id", "date", F.col("demand_model").alias("demand"),
        F.coalesce(F.col("usage_avg_7d"), mean).alias("forecast"), mean.alias("mean_daily"))


def chosen_forecast(clean: DataFrame, chosen: DataFrame) -> DataFrame:
    """Policy input of the days a selection forecast: the winner's forecast instead of the trailing mean.

    ``chosen`` has ``series_id, date, model, forecast`` of each series' winner (``scoring.forecast_vs_actual``).  The
    mean is that of the whole clean series.  A day the winner gave no forecast for keeps its row with a NULL forecast.
    """
    means = clean.select("series_id", "date", F.col("demand_model").alias("demand"),
                         F.avg("demand_model").over(whole()).alias("mean_daily"))
    return (chosen.select("series_id", "date", "model", "forecast").join(means, ["series_id", "date"])
            .select("series_id", "date", "model", "demand", "forecast", "mean_daily"))


def stock_position(clean: DataFrame) -> DataFrame:
    """Recorded units on the shelf, all ages together, per series and day."""
    return clean.select("series_id", "date", sum_columns([F.col(c) for c in stock_columns_in(clean.columns)]).alias("position"))


def order_days(inputs: DataFrame, position: DataFrame, scenario: Scenario = Scenario()) -> DataFrame:
    """Safety stock, target level and order of every day of ``inputs``, from the recorded stock of the day.

    ``inputs`` has ``series_id, date, demand, forecast, mean_daily``; the interval error is measured on its rows.  A
    series too short for an interval error keeps its rows without safety, level and order.
    """
    s = scenario
    sigma = interval_error_std(inputs, s.horizon)
    joined = inputs.join(position, ["series_id", "date"]).join(sigma, "series_id", "left")
    safety = safety_stock(F.lit(s.z), F.lit(s.horizon), sigma_interval=F.col("sigma_interval"))
    level = order_up_to_level(s.horizon * F.col("forecast"), safety, F.col("mean_daily"), F.lit(s.cover_cap))
    return (joined.withColumn("safety", safety).withColumn("level", level)
            .withColumn("order_qty", order_quantity(F.col("level"), F.col("position"))))


# -- the parts of one stock day -------------------------------------------------------------

def issue_order(shelf_life: int, shelf_life_long: int) -> list[tuple[str, int]]:
    """(pool, days left) in issue order: closest to expiry first, the short pool first on a tie."""
    slots = [("short", k) for k in range(1, shelf_life + 1)] + [("long", k) for k in range(1, shelf_life_long + 1)]
    return sorted(slots, key=lambda slot: (slot[1], slot[0] == "long"))


def expiry_first_issue(units: list[Column], need: Column) -> list[Column]:
    """Units taken from each slot, given slots in issue order.

    A slot gives what is still needed after all slots before it.  The running
    sums are plain column sums, so the issue is one projection: no explode, no
    window, no shuffle.  An unknown slot is empty; an unknown need takes unknown units.
    """
    taken, before = [], F.lit(0.0)
    for unit in units:
        u = F.coalesce(unit, F.lit(0.0))
        taken.append(F.when(need.isNotNull(), F.greatest(F.lit(0.0), F.least(u, need - before))))
        before = before + u
    return taken


def oldest_first_issue(df: DataFrame, need: Column) -> DataFrame:
    """Single-pool issue over the stock columns of a daily table, with ``served`` and ``short``."""
    stock = stock_columns_in(df.columns)
    units = [F.coalesce(F.col(c), F.lit(0.0)) for c in stock]
    taken = expiry_first_issue(units, need)
    served = F.when(need.isNotNull(), F.least(need, sum_columns(units)))
    return df.select(
        "series_id", "date",
        *[(u - t).alias(c) for c, u, t in zip(stock, units, taken)],
        served.alias("served"), (need - served).alias("short"))


def stock_ageing(df: DataFrame) -> DataFrame:
    """Discard the units with one day left and move the rest a day closer to expiry."""
    stock = stock_columns_in(df.columns)
    units = [F.coalesce(F.col(c), F.lit(0.0)) for c in stock]
    aged = units[1:] + [F.lit(0.0)]
    return df.select("series_id", "date", units[0].alias("expired"),
                     *[u.alias(c) for c, u in zip(stock, aged)])


def arrival_split(df: DataFrame, lead_time: int, frac_long: float, seed: Column) -> DataFrame:
    """Orders arrive after ``lead_time`` days (``seed`` units before that), split into two pools."""
    arrived = F.coalesce(F.lag("order_qty", lead_time).over(by_day()), seed)
    with_arrival = df.withColumn("arrived", arrived)
    long_units = half_even(F.col("arrived") * F.lit(float(frac_long)))
    return with_arrival.withColumn("arrived_long", long_units).withColumn(
        "arrived_short", F.col("arrived") - F.col("arrived_long"))


def emergency_topup(demand: Column, on_shelf: Column, floor: Column) -> Column:
    """Courier units that keep the floor after today's demand; NULL where demand or stock is unknown."""
    wanted = floor + demand - on_shelf
    return F.when(wanted.isNotNull(), F.greatest(F.lit(0.0), wanted))


# -- measures ---------------------------------------------------------------------------------

def current_kpis(clean: DataFrame) -> DataFrame:
    """Waste, shortage and stock figures of the recorded history, per series."""
    total = sum_columns([F.col(c) for c in stock_columns_in(clean.columns)])
    used, requested = F.col("units_used"), F.col("units_requested")
    shortage = F.coalesce((requested > used).cast("int"), F.lit(0))
    return clean.groupBy("series_id").agg(
        (100 * F.coalesce(F.sum("units_expired"), F.lit(0.0))
         / F.greatest(F.coalesce(F.sum("units_received"), F.lit(0.0)), F.lit(1.0))).alias("waste_pct"),
        (100 * F.avg(shortage)).alias("short_days_pct"),
        F.coalesce(F.sum(F.greatest(requested - used, F.lit(0.0))), F.lit(0.0)).alias("short_units"),
        (F.avg(total) / F.nullif(F.avg("demand_model"), F.lit(0.0))).alias("onhand_days"),
    )


COMPARED = ["waste_pct", "short_days_pct", "short_units", "onhand_days"]
NEW_ONLY = ["min_onhand", "courier_days_pct", "courier_units"]


def policy_comparison(current: DataFrame, new: DataFrame) -> DataFrame:
    """``series_id, metric, current_value, new_value`` from two KPI tables."""
    metrics = COMPARED + NEW_ONLY
    both = current.select("series_id", *[F.col(c).alias(f"_cur_{c}") for c in COMPARED]).join(
        new.select("series_id", *[F.col(c).cast("double").alias(f"_new_{c}") for c in metrics]), "series_id")
    rows = F.inline(F.array(*[
        F.struct(F.lit(c).alias("metric"),
                 (F.col(f"_cur_{c}") if c in COMPARED else F.lit(None).cast("double")).alias("current_value"),
                 F.col(f"_new_{c}").alias("new_value")) for c in metrics]))
    return both.select("series_id", rows)
