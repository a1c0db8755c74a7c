"""SQL fragments for DuckDB: named common table expressions and a way to join them up."""

from __future__ import annotations

W = "PARTITION BY series_id ORDER BY date"
TARGETS = ["units_used", "units_requested"]
STOCK = [f"stock_{k}day_left" for k in range(1, 6)]
LAGGED = ["driver_census_a", "driver_census_b", "driver_census_c", "driver_lab_a", "driver_lab_b", "driver_lab_c"]
DRIVERS = ["driver_scheduled", *LAGGED]
DAILY_NUMBERS = ["units_used", "units_requested", "units_received", "units_expired", *STOCK,
                 "driver_scheduled", "driver_census_a", "driver_census_b", "driver_census_c",
                 "driver_lab_a", "driver_lab_b", "driver_lab_c"]
DIRTY_NUMBERS = ["units_used", "units_requested", "driver_census_a"]

DAILY = """
SELECT l_returnflag || l_linestatus AS series_id, CAST(l_shipdate AS DATE) AS date,
  CAST(SUM(CASE WHEN l_tax < 0.065 THEN l_quantity ELSE 0 END) AS DOUBLE) AS units_used,
  CAST(SUM(l_quantity) AS DOUBLE) AS units_requested,
  CAST(SUM(CASE WHEN l_discount < 0.085 THEN l_quantity ELSE 0 END) AS DOUBLE) AS units_received,
  CAST(SUM(CASE WHEN l_discount > 0.095 THEN 1 ELSE 0 END) AS DOUBLE) AS units_expired,
""" + "".join(f"  CAST(SUM(CASE WHEN l_linenumber = {k} THEN l_quantity ELSE 0 END) AS DOUBLE) AS stock_{k}day_left,\n"
              for k in range(1, 6)) + """
  CAST(COUNT(DISTINCT l_orderkey) AS DOUBLE) AS driver_scheduled,
  CAST(SUM(l_linenumber) AS DOUBLE) AS driver_census_a,
  CAST(COUNT(DISTINCT l_partkey) AS DOUBLE) AS driver_census_b,
  CAST(COUNT(*) AS DOUBLE) AS driver_census_c,
  CAST(SUM(CASE WHEN l_discount > 0.055 THEN 1 ELSE 0 END) AS DOUBLE) AS driver_lab_a,
  CAST(SUM(CASE WHEN l_tax > 0.045 THEN 1 ELSE 0 END) AS DOUBLE) AS driver_lab_b,
  CAST(MAX(l_linenumber) AS DOUBLE) AS driver_lab_c
FROM lineitem GROUP BY 1, 2
"""

DIRTY = """
SELECT series_id, CASE WHEN day(date) = 13 THEN 'bad-date' ELSE CAST(date AS VARCHAR) END AS date_text,
  CASE WHEN day(date) = 17 THEN 'n/a' WHEN day(date) = 18 THEN '-5'
       WHEN day(date) = 28 AND month(date) = 2 THEN '999999'
       ELSE CAST(CAST(units_used AS INT) AS VARCHAR) END AS units_used,
  CASE WHEN month(date) = 3 AND day(date) BETWEEN 2 AND 7 THEN NULL ELSE units_requested END AS units_requested,
  CASE WHEN day(date) IN (9, 10) THEN NULL ELSE driver_census_a END AS driver_census_a,
  1 AS ingest_seq
FROM daily
UNION ALL
SELECT series_id, CAST(date AS VARCHAR), CAST(CAST(units_used AS INT) AS VARCHAR),
  CASE WHEN month(date) % 2 = 0 THEN units_requested + 1 ELSE units_requested END, driver_census_a, 2
FROM daily WHERE day(date) = 21
"""

# Holidays as a table: rules per year, fixed days moved off weekends.
HOLIDAYS = """
WITH years AS (SELECT CAST(unnest(generate_series(1980, 2040)) AS INT) AS y),
fixed AS (
  SELECT make_date(y, m, d) AS n FROM years,
    (VALUES (1, 1), (6, 19), (7, 4), (11, 11), (12, 25)) AS r(m, d)),
moved AS (
  SELECT CASE isodow(n) WHEN 6 THEN n - 1 WHEN 7 THEN n + 1 ELSE n END AS date, n FROM fixed),
months AS (
  SELECT y, m, dow, nth, make_date(y, m, 1) AS first FROM years,
    (VALUES (1, 1, 3), (2, 1, 3), (9, 1, 1), (10, 1, 2), (11, 4, 4)) AS r(m, dow, nth)),
nth_day AS (
  SELECT first + CAST((dow - isodow(first) + 7) % 7 + 7 * (nth - 1) AS INT) AS date, m, y FROM months),
memorial AS (
  SELECT make_date(y, 5, 31) - CAST((isodow(make_date(y, 5, 31)) - 1) AS INT) AS date FROM years)
SELECT CAST(date AS DATE) AS date FROM moved WHERE NOT (month(n) = 6 AND date < DATE '2021-06-18')
UNION SELECT CAST(date AS DATE) FROM nth_day WHERE NOT (m = 1 AND y < 1986)
UNION SELECT CAST(date AS DATE) FROM memorial
"""


def cleaning(p: str, source: str, date_expr: str, seq: str | None, numbers: list[str],
             passthrough: list[str]) -> dict[str, str]:
    """The cleaning stages of ``source`` as tables whose names start with ``p``."""
    raw = numbers + passthrough
    order = ", ".join(([seq] if seq else []) + raw)
    ctes = {}
    ctes[f"{p}dated"] = f"SELECT series_id, {date_expr} AS date, {', '.join(raw)}" + \
        (f", {seq}" if seq else "") + f" FROM {source}"
    ctes[f"{p}dedup"] = f"""
SELECT series_id, date, {', '.join(raw)} FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id, date ORDER BY {order}) AS rn
  FROM {p}dated WHERE date IS NOT NULL) WHERE rn = 1"""
    ctes[f"{p}days"] = f"""
SELECT series_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date
FROM (SELECT series_id, min(date) AS lo, max(date) AS hi FROM {p}dedup GROUP BY 1)"""
    ctes[f"{p}cal"] = f"""
SELECT d.series_id, d.date, {', '.join('r.' + c for c in raw)},
  CAST(r.series_id IS NULL AS INT) AS is_inserted
FROM {p}days d LEFT JOIN {p}dedup r ON d.series_id = r.series_id AND d.date = r.date"""
    ctes[f"{p}num"] = f"""
SELECT series_id, date, {', '.join(f'TRY_CAST({c} AS DOUBLE) AS {c}' for c in numbers)},
  {', '.join(passthrough + ['is_inserted'])} FROM {p}cal"""
    neg = " + ".join(f"CASE WHEN {c} < 0 THEN 1 ELSE 0 END" for c in numbers)
    ctes[f"{p}pos"] = f"""
SELECT series_id, date, {', '.join(f'CASE WHEN {c} >= 0 THEN {c} END AS {c}' for c in numbers)},
  {', '.join(passthrough + ['is_inserted'])}, CAST({neg} AS INT) AS negative_cells,
  row_number() OVER ({W}) - 1 AS t FROM {p}num"""
    isl = ", ".join(f"count({c}) OVER ({W}) AS isl_{c}" for c in numbers)
    near = []
    for c in numbers:
        seen = f"CASE WHEN {c} IS NOT NULL THEN t END"
        back = f"OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        fwd = f"OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
        near += [f"last_value({c} IGNORE NULLS) {back} AS pv_{c}", f"last_value({seen} IGNORE NULLS) {back} AS pt_{c}",
                 f"first_value({c} IGNORE NULLS) {fwd} AS nv_{c}", f"first_value({seen} IGNORE NULLS) {fwd} AS nt_{c}"]
    ctes[f"{p}near"] = f"SELECT *, {isl}, {', '.join(near)} FROM {p}pos"
    runs = ", ".join(
        f"CASE WHEN {c} IS NULL THEN CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) "
        f"OVER (PARTITION BY series_id, isl_{c}) AS INT) ELSE 0 END AS run_{c}" for c in numbers)
    ctes[f"{p}runs"] = f"SELECT *, {runs} FROM {p}near"
    cand = []
    for c in numbers:
        if c in TARGETS:
            e = f"pv_{c}"
        else:
            e = f"coalesce(pv_{c} + (nv_{c} - pv_{c}) / (nt_{c} - pt_{c}) * (t - pt_{c}), pv_{c}, nv_{c})"
        cand.append(f"CASE WHEN {c} IS NULL AND run_{c} <= 2 THEN round_even({e}, 0) END AS fill_{c}")
    ctes[f"{p}cand"] = f"SELECT *, {', '.join(cand)} FROM {p}runs"
    ctes[f"{p}fill"] = f"""
SELECT series_id, date, t, {', '.join(f'coalesce({c}, fill_{c}) AS {c}' for c in numbers)},
  {', '.join(passthrough + ['is_inserted', 'negative_cells'])},
  CAST(({' OR '.join(f'fill_{c} IS NOT NULL' for c in numbers)}) AS INT) AS row_was_imputed FROM {p}cand"""
    return ctes


def annotated(p: str, numbers: list[str], stock: list[str]) -> dict[str, str]:
    """Flags, calendar columns and demand on top of ``{p}fill``."""
    ctes = {}
    ctes[f"{p}p99"] = f"SELECT series_id, {', '.join(f'quantile_cont({c}, 0.99) AS p_{c}' for c in numbers)} " \
                      f"FROM {p}fill GROUP BY 1"
    hits = {c: f"coalesce(p_{c} > 0 AND {c} > 5 * p_{c}, FALSE)" for c in numbers}
    names = ", ".join(f"CASE WHEN {h} THEN '{c}' END" for c, h in hits.items())
    total = " + ".join(f"coalesce({c}, 0)" for c in stock)
    stock_cols = f", {total} AS total" if stock else ""
    ctes[f"{p}base"] = f"""
SELECT f.*, CAST(({' OR '.join(hits.values())}) AS INT) AS has_high_outlier,
  concat_ws(',', {names}) AS high_outlier_columns, dayname(date) AS day_of_week,
  CAST(isodow(date) >= 6 AS INT) AS is_weekend,
  CAST(date IN (SELECT date FROM holidays) AS INT) AS is_holiday,
  CAST(coalesce(units_requested > units_used, FALSE) AS INT) AS is_shortage,
  CASE WHEN units_used IS NOT NULL AND units_requested IS NOT NULL
       THEN greatest(units_used, units_requested) END AS demand_model{stock_cols}
FROM {p}fill f JOIN {p}p99 q USING (series_id)"""
    mismatch = ""
    if stock:
        mismatch = f""", CAST(coalesce(abs(total - lag(total) OVER ({W})
  - (units_received - units_used - units_expired)) > 1, FALSE) AS INT) AS inventory_mismatch"""
    ctes[f"{p}dow"] = f"SELECT series_id, isodow(date) AS wd, median(demand_model) AS lvl FROM {p}base GROUP BY 1, 2"
    ctes[f"{p}res"] = f"""
SELECT *, demand_model - lvl AS resid{mismatch},
  round_even(avg(demand_model) OVER ({W} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 1) AS usage_avg_7d
FROM (SELECT *, isodow(date) AS wd FROM {p}base) JOIN {p}dow USING (series_id, wd)"""
    ctes[f"{p}med"] = f"SELECT series_id, median(resid) AS m FROM {p}res GROUP BY 1"
    ctes[f"{p}mad"] = f"SELECT series_id, median(abs(resid - m)) AS mad FROM {p}res JOIN {p}med USING (series_id) GROUP BY 1"
    ctes[f"{p}clean"] = f"""
SELECT r.*, CAST(coalesce(abs(0.6745::DOUBLE * (resid - m) / CASE WHEN mad = 0 THEN 1 ELSE mad END) > 4, FALSE) AS INT)
  AS is_demand_outlier
FROM {p}res r JOIN {p}med USING (series_id) JOIN {p}mad USING (series_id)"""
    return ctes


CTES: dict[str, str] = {"daily": DAILY, "dirty": DIRTY, "holidays": HOLIDAYS}
CTES |= cleaning("d_", "dirty", "TRY_CAST(date_text AS DATE)", "ingest_seq", DIRTY_NUMBERS, [])
CTES |= annotated("d_", DIRTY_NUMBERS, [])
CTES |= cleaning("c_", "daily", "date", None, DAILY_NUMBERS, [])
CTES |= annotated("c_", DAILY_NUMBERS, STOCK)

CTES["feats"] = f"""
SELECT series_id, date, CAST(t AS INT) AS t, demand_model AS y,
  lag(demand_model, 1) OVER w AS lag_1, lag(demand_model, 7) OVER w AS lag_7, lag(demand_model, 14) OVER w AS lag_14,
  usage_avg_7d AS roll7_mean,
  CASE WHEN count(demand_model) OVER w7 = 7 THEN stddev_samp(demand_model) OVER w7 END AS roll7_std,
  {', '.join(f'CAST(isodow(date) = {k + 1} AS DOUBLE) AS dow_{k}' for k in range(1, 7))},
  CAST(is_holiday AS DOUBLE) AS is_holiday,
  sin(2 * pi() * dayofyear(date) / 365) AS sin_year, cos(2 * pi() * dayofyear(date) / 365) AS cos_year,
  driver_scheduled, {', '.join(f'lag({c}) OVER w AS {c}_lag1' for c in LAGGED)}
FROM c_clean WINDOW w AS ({W}), w7 AS ({W} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)"""
FEATURES = (["lag_1", "lag_7", "lag_14", "roll7_mean", "roll7_std"] + [f"dow_{k}" for k in range(1, 7)]
            + ["is_holiday", "sin_year", "cos_year", "driver_scheduled"] + [f"{c}_lag1" for c in LAGGED])
EXOG = ["is_holiday", "driver_scheduled", "driver_census_a_lag1", "driver_lab_a_lag1"]
LAGGED_EXOG = EXOG[2:]

CTES["windows"] = """
SELECT series_id, n, test_days, n - test_days AS t0, CASE WHEN n - test_days < 35 THEN 'rejected' ELSE 'ok' END AS status
FROM (SELECT series_id, n, CAST(greatest(7, least(168, n - 35, greatest(14, floor(CAST(0.3 AS DOUBLE) * n)))) AS BIGINT)
        AS test_days
      FROM (SELECT series_id, count(*) AS n FROM feats GROUP BY 1))"""
CTES["usable"] = "SELECT series_id, n, t0 FROM windows WHERE status = 'ok'"
CTES["blocks"] = """
SELECT *, n - val_size - test_size AS train_size, n - test_size AS test_start,
  CASE WHEN n - val_size - test_size < 35 THEN 'rejected' ELSE 'ok' END AS status
FROM (SELECT series_id, n, CAST(round_even(n * CAST(0.15 AS DOUBLE), 0) AS BIGINT) AS test_size,
             CAST(round_even(n * CAST(0.15 AS DOUBLE), 0) AS BIGINT) AS val_size
      FROM (SELECT series_id, count(*) AS n FROM feats GROUP BY 1))"""


def needed(text: str, done: list[str]) -> None:
    """Collect the tables a query refers to, directly or through others."""
    import re
    words = set(re.findall(r"\w+", text))
    for name in CTES:
        if name in words and name not in done:
            done.append(name)
            needed(CTES[name], done)


def query(body: str) -> str:
    """A complete statement: the tables ``body`` refers to, then ``body``."""
    names: list[str] = []
    needed(body, names)
    names.sort(key=list(CTES).index)  # a table is defined after those it reads
    if not names:
        return body
    recursive = "RECURSIVE " if any("UNION ALL" in CTES[n] and n in RECURSIVE for n in names) else ""
    return f"WITH {recursive}" + ",\n".join(f"{n} AS {'MATERIALIZED ' if n in MATERIALIZED else ''}({CTES[n]})" for n in names) + "\n" + body


RECURSIVE: set[str] = set()
# Tables that a recursion reads in every step.
MATERIALIZED: set[str] = set()


def r(expr: str, name: str | None = None) -> str:
    """A double rounded to 6 places."""
    return f"round({expr}, 6) + 0.0::DOUBLE AS {name or expr}"


def rounded(names: list[str]) -> str:
    return ", ".join(r(n) for n in names)


KEYS = "series_id, CAST(date AS VARCHAR) AS date"
