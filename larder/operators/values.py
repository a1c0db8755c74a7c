"""Value repairs: numbers from text, negatives, short gaps, implausible highs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.columns import flag
from larder.functions.windows import KEY, day_number, up_to_today, whole


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text to double; what is not a number becomes NULL."""
    numbers = set(columns)
    return df.selectExpr(*[
        f"nanvl(try_cast(`{c}` AS double), CAST(NULL AS double)) AS `{c}`" if c in numbers else f"`{c}`"
        for c in df.columns])


def negatives_to_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """Drop impossible negatives; ``negative_cells`` counts them per row."""
    numbers = set(columns)
    count = " + ".join(f"if(`{c}` < 0, 1, 0)" for c in columns) or "0"
    kept = [f"CASE WHEN `{c}` >= 0 THEN `{c}` END AS `{c}`" if c in numbers else f"`{c}`" for c in df.columns]
    return df.selectExpr(*kept, f"{count} AS negative_cells")


def null_run_length(df: DataFrame, column: str, output: str = "run_length") -> DataFrame:
    """Length of the run of missing values a row is in, 0 where a value is present.

    The distance between the present values on either side; the later one is
    found as the latest present value in reversed day order, which is linear
    where a frame reaching to the end of the series would be quadratic.
    """
    reversed_days = Window.partitionBy(KEY).orderBy(F.desc("date"))
    seen = F.when(F.col(column).isNotNull(), F.col("_t"))
    numbered = df.withColumns({"_t": day_number(), "_n": F.count(F.lit(1)).over(whole())})
    before = F.coalesce(F.last(seen, ignorenulls=True).over(up_to_today()), F.lit(-1))
    after = F.coalesce(
        F.last(seen, ignorenulls=True)
        .over(reversed_days.rowsBetween(Window.unboundedPreceding, 0)), F.col("_n"))
    return (numbered.withColumn("_before", before).withColumn("_after", after)
            .withColumn(output, F.when(F.col(column).isNotNull(), 0)
                        .otherwise(F.col("_after") - F.col("_before") - 1).cast("int"))
            .drop("_t", "_n", "_before", "_after"))


def fill_short_gaps(df: DataFrame, carried: list[str], interpolated: list[str], max_gap: int = 2,
                    past_only: bool = False) -> DataFrame:
    """Fill runs of at most ``max_gap`` missing days; longer runs stay missing.

    ``carried`` columns take the last value before the gap.  ``interpolated`` ones
    go linearly between the two neighbours and take the nearest value at the ends
    of a series; with ``past_only`` they are carried too, so that no filled day
    uses a later one.  Fills are whole units.  Adds ``row_was_imputed``.

    A short gap has a present value, or the end of the series, within ``max_gap``
    days on either side, so a few fixed offsets decide and every column is served by
    the same sort.
    """
    columns = carried + interpolated
    if not columns or max_gap < 1:
        return df.withColumn("row_was_imputed", F.lit(0))
    numbered = df.withColumns({"_t": day_number(), "_n": F.count(F.lit(1)).over(whole())})
    steps = range(1, max_gap + 1)
    by_date = "OVER (PARTITION BY series_id ORDER BY date)"
    neighbours, fills = [], []
    for c in columns:
        neighbours += [f"lag(`{c}`, {i}) {by_date} AS _lag{i}_{c}" for i in steps]
        neighbours += [f"lead(`{c}`, {i}) {by_date} AS _lead{i}_{c}" for i in steps]
        before = f"coalesce({', '.join(f'_lag{i}_{c}' for i in steps)})"
        after = f"coalesce({', '.join(f'_lead{i}_{c}' for i in steps)})"
        # Days to the present value, or to just outside the series, on either side; NULL if too far.
        back = " ".join(f"WHEN _lag{i}_{c} IS NOT NULL THEN {i}" for i in steps) + f" WHEN _t < {max_gap} THEN _t + 1"
        on = " ".join(f"WHEN _lead{i}_{c} IS NOT NULL THEN {i}" for i in steps) + f" WHEN _n - 1 - _t < {max_gap} THEN _n - _t"
        back, on = f"(CASE {back} END)", f"(CASE {on} END)"
        candidate = before
        if c not in carried and not past_only:
            line = f"{before} + ({after} - {before}) / ({back} + {on}) * {back}"
            candidate = f"coalesce({line}, {before}, {after})"
        fills.append(f"CASE WHEN `{c}` IS NULL AND {back} + {on} - 1 <= {max_gap} THEN bround({candidate}, 0) END AS _fill_{c}")
    near = numbered.selectExpr("*", *neighbours).selectExpr(*df.columns, *fills)
    touched = " OR ".join(f"_fill_{c} IS NOT NULL" for c in columns)
    return near.selectExpr(
        *[f"coalesce(`{c}`, _fill_{c}) AS `{c}`" if c in columns else f"`{c}`" for c in df.columns],
        f"if({touched}, 1, 0) AS row_was_imputed")


def high_outlier_flag(df: DataFrame, columns: list[str], mult: float = 5.0) -> DataFrame:
    """Flag values far beyond a column's own upper range (99th percentile of the series).

    Adds ``has_high_outlier`` and ``high_outlier_columns`` (names on this row).
    """
    scales = [f"percentile(`{c}`, 0.99) OVER (PARTITION BY series_id) AS _p99_{c}" for c in columns]
    names = ", ".join(f"if(_p99_{c} > 0 AND `{c}` > {mult} * _p99_{c}, '{c}', NULL)" for c in columns)
    scaled = df.selectExpr("*", *scales)
    flagged = scaled.selectExpr(*df.columns, f"array_compact(cast(array({names}) AS array<string>)) AS high_outlier_columns")
    return flagged.withColumn("has_high_outlier", flag(F.size("high_outlier_columns") > 0))
