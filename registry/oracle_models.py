"""SQL for the queries of ``registry.models`` that fit no model."""

from __future__ import annotations

from registry import oracle_stock  # noqa: F401  (defines the score and ledger tables used here)
from registry.sql import CTES, FEATURES, KEYS, MATERIALIZED, RECURSIVE, W, query, r, rounded

CTES["hw_start"] = f"""
SELECT series_id, avg(v) FILTER (WHERE t < 7) AS level,
  (avg(v) FILTER (WHERE t >= 7) - avg(v) FILTER (WHERE t < 7)) / 7 AS trend,
  {', '.join(f'max(v) FILTER (WHERE t = {k}) AS y{k}' for k in range(7))}
FROM (SELECT series_id, t, coalesce(y, avg(y) OVER (PARTITION BY series_id)) AS v FROM feats WHERE t < 14) GROUP BY 1"""
A, B, G = (f"CAST({x} AS DOUBLE)" for x in (0.3, 0.05, 0.2))
RECURSIVE.add("hw_run")
CTES["hw_run"] = f"""
SELECT series_id, CAST(-1 AS INT) AS t, level, trend, {', '.join(f'y{k} - level AS s{k + 1}' for k in range(7))},
  CAST(NULL AS DOUBLE) AS forecast FROM hw_start
UNION ALL
SELECT series_id, t, nl AS level, {B} * (nl - level) + (1 - {B}) * trend AS trend, s2 AS s1, s3 AS s2, s4 AS s3, s5 AS s4,
  s6 AS s5, s7 AS s6, {G} * (v - (level + trend)) + (1 - {G}) * s1 AS s7, forecast
FROM (SELECT *, {A} * (v - s1) + (1 - {A}) * (level + trend) AS nl FROM (
  SELECT h.series_id, f.t, level, trend, s1, s2, s3, s4, s5, s6, s7, level + trend + s1 AS forecast,
    coalesce(f.y, level + trend + s1) AS v
  FROM hw_run h JOIN feats f ON h.series_id = f.series_id AND f.t = h.t + 1))"""

VARIANTS = [("trend=add,season=add", "FALSE"), ("trend=damped,season=add", "FALSE"), ("trend=add,season=mul", "TRUE"),
            ("trend=damped,season=mul", "TRUE"), ("trend=none,season=add", "FALSE"), ("trend=none,season=mul", "TRUE")]
THETAS = ["deseasonalize=true,method=auto", "deseasonalize=true,method=additive",
          "deseasonalize=true,method=multiplicative", "deseasonalize=false,method=auto"]
ORDERS = ["(1,1,1)x(1,0,1,7)", "(0,1,1)x(0,0,1,7)", "(1,1,0)x(1,0,0,7)", "(2,1,1)x(1,0,1,7)", "(1,1,2)x(1,0,1,7)",
          "(1,1,1)x(0,0,1,7)", "(1,1,1)x(1,0,0,7)", "(2,1,2)x(1,0,1,7)", "(1,0,1)x(1,1,1,7)", "(0,1,1)x(0,1,1,7)"]
OPTIONS = ", ".join([f"('holt_winters', '{n}', {m})" for n, m in VARIANTS] + [f"('theta', '{n}', FALSE)" for n in THETAS]
                    + [f"('arx', '{n}', FALSE)" for n in ORDERS])

CTES["gap_feed"] = """
SELECT series_id, date, y FROM feats WHERE NOT (day(date) BETWEEN 4 AND 6 OR (day(date) = 20 AND month(date) % 2 = 0))"""

SQL = {
    "fc_holt_winters": query(
        f"SELECT series_id, CAST(date AS VARCHAR) AS date, 'holt_winters' AS model, {rounded(['forecast'])}, {r('y', 'actual')} "
        "FROM hw_run JOIN feats USING (series_id, t)"),
    "grid_params": query(f"""
SELECT series_id, model, config FROM (SELECT series_id, bool_and(coalesce(y > 0, FALSE)) AS pos FROM feats GROUP BY 1),
  (VALUES {OPTIONS}) AS o(model, config, needs) WHERE pos OR NOT needs"""),
    "adopt_rule": query(f"""
SELECT series_id, {r('d', 'default_mase')}, {r('CASE WHEN better THEN b ELSE d END', 'best_mase')},
  CAST(better AS INT) AS adopted, CASE WHEN better THEN m ELSE 'mean_7' END AS config
FROM (SELECT *, round(b, 9) < round(d, 9) AS better FROM (
  SELECT series_id, max(mase) FILTER (WHERE model = 'mean_7') AS d, min(mase) FILTER (WHERE model <> 'mean_7') AS b,
    arg_min(model, round(mase, 9)) FILTER (WHERE model <> 'mean_7') AS m FROM v_score GROUP BY 1))"""),
    "stream_daily_demand": query("""
SELECT event_type AS series_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, CAST(count(*) AS DOUBLE) AS units_used,
  CAST(count(*) FILTER (WHERE value > 50) AS DOUBLE) AS units_requested
FROM events GROUP BY 1, 2"""),
    "stream_forecast": query(f"""
SELECT {KEYS}, {r('lag_7', 'forecast')}, {r('y', 'actual')} FROM feats"""),
    "stream_forecast_gaps": query(f"""
SELECT {KEYS}, {r('lag(y, 7) OVER (' + W + ')', 'forecast')}, {r('y', 'actual')} FROM (
  SELECT d.series_id, d.date, least(y, CASE WHEN day(d.date) = 9 THEN y - 3 END) AS y FROM (
    SELECT series_id, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM gap_feed GROUP BY 1) d
  LEFT JOIN gap_feed g ON g.series_id = d.series_id AND g.date = d.date)"""),
    "stream_stock_ledger": query(f"""
SELECT {KEYS}, {rounded(['demand', 'ordered', 'arrived_short', 'arrived_long', 'expired_short', 'expired_long', 'courier',
                         'served', 'short', 'onhand_short', 'onhand_long'])} FROM p_book"""),
}

CTES["scalable"] = f"""
SELECT * FROM feats JOIN usable USING (series_id) WHERE {' AND '.join(f'{c} IS NOT NULL' for c in FEATURES)}"""
SQL["scale_features"] = query(f"""
SELECT {KEYS}, {', '.join(f'round(({c} - m_{c}) / s_{c}, 6) + 0.0::DOUBLE AS {c}' for c in FEATURES)} FROM scalable,
  (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}' for c in FEATURES)} FROM scalable
   WHERE t >= 14 AND t < t0)""")

CTES["in_block"] = "SELECT * FROM feats JOIN usable USING (series_id)"
CTES["fold_starts"] = """
SELECT series_id, CAST(unnest(range(0, CAST((n - t0 + 13) // 14 AS BIGINT))) AS INT) AS fold, t0 FROM usable"""
CTES["fold_scales"] = f"""
SELECT s.series_id, s.fold, {', '.join(f'avg({c}) AS m_{c}, nullif(round(stddev_samp({c}), 9), 0) AS z_{c}, stddev_samp({c}) AS s_{c}' for c in FEATURES)}
FROM fold_starts s JOIN in_block b ON b.series_id = s.series_id AND b.t >= 14 AND b.t < s.t0 + s.fold * 14
  AND {' AND '.join(f'b.{c} IS NOT NULL' for c in FEATURES)} GROUP BY 1, 2"""
SQL["scale_fold_features"] = query(f"""
SELECT b.series_id, CAST(date AS VARCHAR) AS date, f.fold,
  {', '.join(f'round(CASE WHEN z_{c} IS NOT NULL THEN ({c} - m_{c}) / s_{c} END, 6) + 0.0::DOUBLE AS {c}' for c in FEATURES)}
FROM in_block b JOIN fold_scales f ON b.series_id = f.series_id AND f.fold = (b.t - b.t0) // 14 WHERE b.t >= b.t0 AND b.t < b.n""")

# Smoothing with chosen weights, written as a recursion over days for every series, form and setting of the weight grid.
# The grid, in the order in which ties are resolved.
LEVELS, TRENDS, SEASONS, DAMPINGS = (0.05, 0.1, 0.2, 0.3, 0.5), (0.0, 0.01, 0.05), (0.01, 0.05, 0.1, 0.2), (0.8, 0.9, 0.98)
DEFAULT_FORM = "trend=add,season=add"


def _grid(forms: list[str]) -> str:
    rows = []
    for form in forms:
        trends = (0.0,) if "trend=none" in form else TRENDS
        dampings = DAMPINGS if "damped" in form else (1.0,)
        settings = [(a, b, g, p) for a in LEVELS for b in trends for g in SEASONS for p in dampings]
        rows += [f"('{form}', {i}, {'season=mul' in form}, {'trend=none' not in form}, {a!r}::DOUBLE, {b!r}::DOUBLE, {g!r}::DOUBLE, {p!r}::DOUBLE)"
                 for i, (a, b, g, p) in enumerate(settings)]
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS v(form, idx, mul, trended, a, b, g, phi)"


def _ratio(x: str, y: str) -> str:
    return f"CASE WHEN abs({y}) > 1e-9 THEN ({x}) / ({y}) ELSE 1.0::DOUBLE END"


def smoothing(p: str, forms: list[str]) -> None:
    """``{p}run``: forecasts of every day, form and setting."""
    CTES[f"{p}grid"] = _grid(forms)
    seasons = ", ".join(f"CASE WHEN mul THEN y{k} / CASE WHEN level = 0 THEN 1 ELSE level END ELSE y{k} - level END AS s{k + 1}" for k in range(7))
    RECURSIVE.add(f"{p}run")
    CTES[f"{p}run"] = f"""
SELECT series_id, form, idx, mul, a, b, g, phi, CAST(-1 AS INT) AS t, level, CASE WHEN trended THEN trend ELSE 0.0::DOUBLE END AS trend,
  {seasons}, CAST(NULL AS DOUBLE) AS forecast, CAST(NULL AS DOUBLE) AS y FROM hw_start, {p}grid
UNION ALL
SELECT series_id, form, idx, mul, a, b, g, phi, t, nl AS level, b * (nl - level) + (1 - b) * phi * trend AS trend, s2 AS s1, s3 AS s2, s4 AS s3,
  s5 AS s4, s6 AS s5, s7 AS s6, g * CASE WHEN mul THEN {_ratio('v', 'base')} ELSE v - base END + (1 - g) * s1 AS s7, forecast, y
FROM (SELECT *, a * CASE WHEN mul THEN {_ratio('v', 's1')} ELSE v - s1 END + (1 - a) * base AS nl FROM (
  SELECT *, coalesce(y, forecast) AS v FROM (
    SELECT *, CASE WHEN mul THEN base * s1 ELSE base + s1 END AS forecast FROM (
      SELECT h.* EXCLUDE (t, forecast, y), f.t, f.y, level + phi * trend AS base
      FROM {p}run h JOIN feats f ON h.series_id = f.series_id AND f.t = h.t + 1))))"""


def chosen(p: str, run: str, split: str) -> None:
    """``{p}best``: setting of each series, form and fold with the least past error; ``{p}fc``: its forecasts of the fold's days."""
    CTES[f"{p}in"] = f"""
SELECT h.series_id, form, idx, a, b, g, h.t, forecast, y, n, t0, greatest(-1, CAST(floor((h.t - t0) / 14) AS INT)) AS fold
FROM {run} h JOIN {split} s ON h.series_id = s.series_id WHERE h.t >= 0 AND h.t < n
  AND NOT (mul AND h.series_id IN (SELECT f.series_id FROM feats f JOIN {split} z ON f.series_id = z.series_id WHERE f.t < z.t0 AND f.y <= 0))"""
    CTES[f"{p}best"] = f"""
SELECT series_id, form, fold, idx, a, b, g FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id, form, fold ORDER BY past, idx) AS rn FROM (
    SELECT *, sum(sq) OVER (PARTITION BY series_id, form, idx ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past
    FROM (SELECT series_id, form, idx, fold, any_value(a) AS a, any_value(b) AS b, any_value(g) AS g,
        coalesce(sum(power(y - forecast, 2)) FILTER (WHERE t >= 14), 0) AS sq FROM {p}in GROUP BY 1, 2, 3, 4)) WHERE fold >= 0) WHERE rn = 1"""
    CTES[f"{p}fc0"] = f"""
SELECT i.series_id, f.date, i.form AS model, i.forecast, i.y AS actual FROM {p}in i JOIN {p}best USING (series_id, form, fold, idx)
JOIN feats f ON f.series_id = i.series_id AND f.t = i.t WHERE i.t >= i.t0"""


FORMS = [n for n, _ in VARIANTS]
smoothing("h1_", [DEFAULT_FORM])
smoothing("h6_", FORMS)
chosen("h1b_", "h1_run", "usable")
chosen("h6b_", "h6_run", "usable")
chosen("h6v_", "h6_run", "val_split")
LONG = f"SELECT {KEYS}, model, {rounded(['forecast', 'actual'])}"
SQL["fc_holt_winters_fit"] = query(f"{LONG} FROM (SELECT * REPLACE ('holt_winters' AS model) FROM h1b_fc0)")
SQL["fc_holt_winters_variants"] = query(f"{LONG} FROM h6b_fc0")


def tuned(p: str, name: str, default: str) -> None:
    """``{p}report``: adoption per series from the forecasts ``{p}fc0`` of all configurations on the validation block."""
    CTES[f"{p}k"] = f"SELECT series_id, count(DISTINCT model) AS k FROM {p}fc0 WHERE actual - forecast IS NOT NULL GROUP BY 1"
    CTES[f"{p}mase"] = f"""
SELECT series_id, model, e / nullif(q_scale, 0) AS mase FROM (SELECT series_id, model, avg(abs(actual - forecast)) FILTER (WHERE common) AS e FROM (
  SELECT f.*, count(actual - forecast) OVER (PARTITION BY series_id, date) = k AS common FROM {p}fc0 f JOIN {p}k USING (series_id))
  GROUP BY 1, 2) JOIN v_q USING (series_id)"""
    SQL[f"tune_{name}"] = query(f"""
SELECT series_id, '{name}' AS model, round(d, 4) AS default_mase, round(CASE WHEN better THEN m ELSE d END, 4) AS best_mase,
  CAST(better AS INT) AS adopted, CASE WHEN better THEN c ELSE '{default}' END AS config, CASE WHEN better THEN c ELSE '{default}' END AS settings
FROM (SELECT *, round(m, 9) < round(d, 9) AS better FROM (
  SELECT series_id, max(mase) FILTER (WHERE model = '{default}') AS d,
    arg_min(mase, (round(mase, 9), model)) FILTER (WHERE model <> '{default}') AS m,
    arg_min(model, (round(mase, 9), model)) FILTER (WHERE model <> '{default}') AS c FROM {p}mase GROUP BY 1))""")


tuned("h6v_", "holt_winters", DEFAULT_FORM)

# The stream learns with the first setting of the grid until a version of weights holds, and with that from its first day on.
MATERIALIZED.add("sr_days")
CTES["sr_days"] = f"""
SELECT f.series_id, f.t, f.y, coalesce(w.a, {LEVELS[0]!r}) AS a, coalesce(w.b, {TRENDS[0]!r}) AS b, coalesce(w.g, {SEASONS[0]!r}) AS g, w.a IS NOT NULL AS held
FROM feats f JOIN usable u ON f.series_id = u.series_id
LEFT JOIN h1b_best w ON w.series_id = f.series_id AND f.t >= u.t0 AND w.fold = (f.t - u.t0) // 14"""
RECURSIVE.add("sr_run")
CTES["sr_run"] = f"""
SELECT series_id, CAST(-1 AS INT) AS t, level, trend, {', '.join(f'y{k} - level AS s{k + 1}' for k in range(7))},
  CAST(NULL AS DOUBLE) AS forecast, FALSE AS held FROM hw_start
UNION ALL
SELECT series_id, t, nl AS level, b * (nl - level) + (1 - b) * trend AS trend, s2 AS s1, s3 AS s2, s4 AS s3, s5 AS s4, s6 AS s5, s7 AS s6,
  g * (v - (level + trend)) + (1 - g) * s1 AS s7, forecast, held
FROM (SELECT *, a * (v - s1) + (1 - a) * (level + trend) AS nl FROM (
  SELECT h.series_id, d.t, level, trend, s1, s2, s3, s4, s5, s6, s7, a, b, g, d.held, level + trend + s1 AS forecast,
    coalesce(d.y, level + trend + s1) AS v FROM sr_run h JOIN sr_days d ON h.series_id = d.series_id AND d.t = h.t + 1))"""
SQL["stream_refit_cadence"] = query(f"""
SELECT {KEYS}, {r('forecast')}, {r('y', 'actual')} FROM sr_run JOIN feats USING (series_id, t) WHERE held""")
