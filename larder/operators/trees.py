"""Pooled forecasters: one distributed model per fold over all series.

A forest per series would be one Spark job per series and fold.  Pooled, each
fold is one distributed fit whatever the number of series; demand and its lags
are divided by the series' mean before the test block, so that large series do
not drown small ones.  With one series this is the usual per-series back-test.

A fit whose rows one task holds is grown in one task (``grown``), and the fits of a back-test or a rung are the tasks of one job.
Every larger fit, whatever its model, trial or fold, is a job of ``pyspark.ml`` in one pool (``fit_all``); ``halving`` gives trials more folds only while they are among the better half.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators import grown
from larder.operators.features import FEATURES, LAG_FEATURES, ROLL_FEATURES
from larder.operators.splits import WARMUP, fold_number, fold_start, test_rows, training_rows
from larder.session import stored_by

SEED = 42
# Fits submitted to the cluster at the same time.
PARALLEL_FITS = 12
# Rows that a task of a fit takes; below two tasks a core it takes fewer.
ROWS_A_TASK = 500_000
# Rows up to which trees are grown in one task (README has the memory that they take).
ROWS_IN_ONE = 100_000
_LEARNERS = {"forest": RandomForestRegressor, "boost": GBTRegressor, "linear": LinearRegression}


@dataclass(frozen=True)
class TreeModel:
    """A tree learner and its settings, under the name its forecasts carry."""

    name: str
    kind: str
    params: dict = field(default_factory=dict)

    def estimator(self):
        seed = {} if self.kind == "linear" else {"seed": SEED}
        return _LEARNERS[self.kind](featuresCol="vec", labelCol="label", predictionCol="_pred", **{**seed, **self.params})

    def with_params(self, name: str | None = None, **params) -> "TreeModel":
        return TreeModel(name or self.name, self.kind, {**self.params, **params})


# Default settings, for the library and the registered queries alike.  The forest's unlimited depth becomes 8, as a distributed
# tree doubles its statistics per level; leaf-wise growth to 31 leaves becomes depth 5 with 20 rows per leaf.
GBT = TreeModel("gbt", "boost", {
    "maxIter": 300, "maxDepth": 3, "stepSize": 0.05, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"})
FOREST = TreeModel("random_forest", "forest", {
    "numTrees": 300, "maxDepth": 8, "minInstancesPerNode": 1, "featureSubsetStrategy": "all"})
GBT_LEAFWISE = TreeModel("gbt_leafwise", "boost", {
    "maxIter": 300, "maxDepth": 5, "minInstancesPerNode": 20, "stepSize": 0.05, "subsamplingRate": 0.8,
    "featureSubsetStrategy": "0.8"})


def training_table(split_features: DataFrame) -> DataFrame:
    """Assembled, scaled rows of every series, written once for all fits.

    Rows with a missing feature can be neither learned from nor forecast: they have a NULL vector.
    ``scale`` is the series' mean demand before the test block.
    """
    means = (split_features.filter(F.col("t") < F.col("t0")).groupBy("series_id")
             .agg(F.avg("y").alias("_mean")))
    scale = F.when(F.col("_mean") > 0, F.col("_mean")).otherwise(F.lit(1.0))
    ready = (split_features.filter(F.col("t") >= WARMUP).join(means, "series_id").withColumn("scale", scale))
    shrunk = [*LAG_FEATURES, *ROLL_FEATURES]
    scaled = ready.withColumns({c: F.col(c) / F.col("scale") for c in shrunk})
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="vec", handleInvalid="keep").transform(scaled)
    whole = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in FEATURES)
    known = vectors.withColumn("vec", F.when(F.expr(whole), F.col("vec")))
    return stored_by(known.select("series_id", "date", "t", "n", "t0", "y", "scale",
                                  (F.col("y") / F.col("scale")).alias("label"), "vec"), "training")


def learnable(table: DataFrame) -> DataFrame:
    return table.filter(F.col("label").isNotNull() & F.col("vec").isNotNull())


def for_fits(rows: DataFrame, count: int) -> DataFrame:
    """``rows`` in partitions that follow their ``count`` instead of the number of files: every round of a fit is jobs over all of
    them, and each task sends the driver a result."""
    least = 2 * rows.sparkSession.sparkContext.defaultParallelism
    return rows.coalesce(max(least, -(-count // ROWS_A_TASK)))


def trainable_rows(table: DataFrame, refit_every: int, folds: int) -> list[int]:
    """Number of rows that each fold's model learns from: one job for all folds."""
    first = F.greatest(F.lit(0), fold_number(refit_every) + 1)  # the first fold that has a row in its past
    counts = {r.fold: r["count"] for r in learnable(table).groupBy(first.alias("fold")).count().collect()}
    return [sum(n for f, n in counts.items() if f <= fold) for fold in range(folds)]


def _fitted(table: DataFrame, model: TreeModel, fold: int, refit_every: int, count: int):
    return model.estimator().fit(for_fits(learnable(training_rows(table, fold, refit_every)).select("vec", "label"), count))


def _forecasts(table: DataFrame, model: TreeModel, fold: int, refit_every: int, fitted) -> DataFrame:
    """Forecasts of those of one fold's days whose features are all known."""
    days = test_rows(table, fold, refit_every).filter(F.col("vec").isNotNull())
    return fitted.transform(days).select("series_id", "date", F.lit(model.name).alias("model"),
                                         (F.col("_pred") * F.col("scale")).alias("forecast"), F.col("y").alias("actual"))


def in_one_task(model: TreeModel, count: int) -> bool:
    """Whether a fit of ``count`` rows is grown in one task."""
    return count <= ROWS_IN_ONE and grown.known(model.kind, model.params)


def _work(model: TreeModel) -> int:
    return model.params.get("maxIter", model.params.get("numTrees", 20)) * model.params.get("maxDepth", 5)


def _grown(table: DataFrame, jobs: list[tuple[TreeModel, int]], refit_every: int) -> DataFrame:
    """Forecasts of fits that are a task each: the rows that a job learns from and the days it forecasts go to its task."""
    jobs = sorted(jobs, key=lambda j: -_work(j[0]))  # the longest start first
    every = F.array(*[F.struct(F.lit(i).alias("job"), F.lit(f).alias("fold")) for i, (_, f) in enumerate(jobs)])
    learns = F.col("label").isNotNull() & (F.col("t") >= WARMUP)
    day = (F.col("t") >= F.col("t0"))

    def past(j):
        start = fold_start(j["fold"], refit_every)
        return learns & (F.col("t") < start) & (start < F.col("n"))
    rows = table.filter(F.col("vec").isNotNull()).select(
        "series_id", "date", "t", F.xxhash64("series_id").alias("series"), vector_to_array("vec").alias("x"), "label", "scale",
        F.col("y").alias("actual"), F.explode(F.concat(
            F.transform(F.filter(every, past), lambda j: F.struct(j["job"].alias("job"), F.lit(True).alias("learn"))),
            F.transform(F.filter(every, lambda j: day & (j["fold"] == fold_number(refit_every))),
                        lambda j: F.struct(j["job"].alias("job"), F.lit(False).alias("learn"))))).alias("_at"))
    dealt = rows.select("*", "_at.*").drop("_at").repartitionById(len(jobs), F.col("job"))
    return dealt.mapInArrow(grown.fitter([(m.name, m.kind, m.params) for m, _ in jobs], SEED),
                            "series_id string, date date, model string, forecast double, actual double")


def _unknown(table: DataFrame, jobs: list[tuple[TreeModel, int]], rows: list[int], refit_every: int) -> DataFrame:
    """Rows without a forecast, of all jobs in one scan: days with a missing feature, or of a fold from which nothing could be learned."""
    every = F.array(*[F.struct(F.lit(m.name).alias("model"), F.lit(f).alias("fold"), F.lit(rows[f] > 0).alias("learned")) for m, f in jobs])
    missing, fold = F.col("vec").isNull(), fold_number(refit_every)
    days = table.filter(F.col("t") >= F.col("t0")).select("series_id", "date", "y", F.explode(F.filter(
        every, lambda j: (j["fold"] == fold) & (missing | ~j["learned"]))).alias("_job"))
    return days.select("series_id", "date", F.col("_job.model").alias("model"), F.lit(None).cast("double").alias("forecast"),
                       F.col("y").alias("actual"))


def folds_of(split: DataFrame, refit_every: int) -> int:
    """Number of folds of the longest test block."""
    longest = split.agg(F.max(F.col("n") - F.col("t0"))).first()[0] or 0
    return -(-int(longest) // refit_every)


def fit_all(table: DataFrame, jobs: list[tuple[TreeModel, int]], refit_every: int) -> DataFrame:
    """Forecasts of (model, fold) jobs: fits run side by side, as tasks of one job or in one pool; forecasts are written once.

    Every day of a fold has a row; the forecast is NULL where a feature is missing or nothing could be learned.
    """
    rows = trainable_rows(table, refit_every, 1 + max(f for _, f in jobs))

    learned = [(m, f) for m, f in jobs if rows[f]]
    small = [(m, f) for m, f in learned if in_one_task(m, rows[f])]
    large = [(m, f) for m, f in learned if not in_one_task(m, rows[f])]
    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        fitted = list(pool.map(lambda job: _fitted(table, *job, refit_every, rows[job[1]]), large))
    parts = [_forecasts(table, m, f, refit_every, x) for (m, f), x in zip(large, fitted, strict=True)]
    if small:
        parts.append(_grown(table, small, refit_every))
    parts.append(_unknown(table, jobs, rows, refit_every))
    return stored_by(reduce(lambda a, b: a.unionByName(b), parts), "tree-forecasts")


def tree_forecasts(table: DataFrame, models: list[TreeModel], refit_every: int, folds: int) -> DataFrame:
    """Test-block forecasts of several pooled models over all folds."""
    return fit_all(table, [(m, f) for m in models for f in range(folds)], refit_every)


@dataclass
class Trial:
    """A setting in a search: the folds it was given and its score on them."""

    model: TreeModel
    folds: int = 0
    mase: float | None = None


def halving(table: DataFrame, default: TreeModel, trials: list[TreeModel], refit_every: int, folds: int, score) -> tuple[
        list[Trial], DataFrame]:
    """Search by rungs: (every trial with its score, forecasts of those that came through).

    All settings forecast the first folds; the better half of the trials goes on to twice as many, and so on to the last fold.  The
    default always goes on.  ``score(forecasts)`` gives ``{model name: score}``; a setting without a score is the worst.
    Fits of a rung are jobs of one pool; a fold is fitted once.
    """
    alive, done = [Trial(t) for t in trials], [Trial(default)]
    everyone, parts, at = [*done, *alive], [], 0
    rungs = max(1, (len(trials)).bit_length())
    for rung in range(rungs):
        upto = max(at + 1, -(-folds // 2 ** (rungs - 1 - rung)))
        upto = min(upto, folds)
        runners = [*done, *alive]
        if upto > at:
            parts.append(fit_all(table, [(t.model, f) for t in runners for f in range(at, upto)], refit_every))
        at = upto
        names = [t.model.name for t in runners]
        so_far = reduce(lambda a, b: a.unionByName(b), parts).filter(F.col("model").isin(names))
        scores = score(so_far)
        for t in runners:
            t.folds, t.mase = at, scores.get(t.model.name)
        if rung < rungs - 1:
            alive = sorted(alive, key=lambda t: (t.mase is None, t.mase))[:max(1, len(alive) // 2)]
    return everyone, so_far


def importances(table: DataFrame, model: TreeModel) -> DataFrame:
    """``name, value`` importances of a model of all complete rows."""
    rows = learnable(table)
    count = rows.count()
    if in_one_task(model, count):
        one = rows.select(F.lit(0).alias("job"), F.lit(True).alias("learn"), F.xxhash64("series_id").alias("series"), "t",
                          vector_to_array("vec").alias("x"), "label").repartition(1)
        found = one.mapInArrow(grown.fitter([(model.name, model.kind, model.params)], SEED, FEATURES), "name string, value double")
        by = {r["name"]: r["value"] for r in found.collect()}  # a row for each feature
        values = [by.get(c, 0.0) for c in FEATURES]
    else:
        values = model.estimator().fit(for_fits(rows.select("vec", "label"), count)).featureImportances.toArray()
    return table.sparkSession.createDataFrame(
        [(c, float(v)) for c, v in zip(FEATURES, values)], "name string, value double")
