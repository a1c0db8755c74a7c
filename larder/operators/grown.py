"""Trees of one fit grown in one task, for fits whose rows one task holds.

A boosting round of ``pyspark.ml`` is a few jobs whatever the number of rows, so hundreds of rounds for every fold and setting
are mostly starts of jobs.  Here a fit is one task and the fits of a back-test are the tasks of one job.  The method is that of
``pyspark.ml``: columns cut at equally frequent values, splits by variance, a draw of columns for each node, and for boosting a
first tree of the label and later ones of twice the remainder.  Draws follow the sorted rows, so the layout of a table does not
matter.  Larger fits take ``pyspark.ml`` (``trees.fit_all``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Settings that are understood; a model with any other takes ``pyspark.ml``.
DEFAULTS = {"boost": {"maxIter": 20, "maxDepth": 5, "stepSize": 0.1, "subsamplingRate": 1.0, "minInstancesPerNode": 1,
                      "featureSubsetStrategy": "all", "maxBins": 32},
            "forest": {"numTrees": 20, "maxDepth": 5, "subsamplingRate": 1.0, "minInstancesPerNode": 1,
                       "featureSubsetStrategy": "0.3333", "maxBins": 32, "bootstrap": True}}


def known(kind: str, params: dict) -> bool:
    """Whether a model of these settings can be grown here."""
    draw = params.get("featureSubsetStrategy", "all")
    return kind in DEFAULTS and set(params) <= set(DEFAULTS[kind]) and (draw == "all" or "." in draw)


def cuts(values: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` thresholds midway between neighbouring values, at equal numbers of rows."""
    found, count = np.unique(values, return_counts=True)
    if len(found) - 1 > most:
        upto = np.cumsum(count)
        target = upto[-1] / (most + 1) * np.arange(1, most + 1)
        after = np.minimum(np.searchsorted(upto, target), len(found) - 2)
        before = np.maximum(after - 1, 0)
        at = np.unique(np.where(np.abs(upto[before] - target) < np.abs(upto[after] - target), before, after))
    else:
        at = np.arange(len(found) - 1)
    return (found[at] + found[at + 1]) / 2


class _Grower:
    """Trees over fixed bins; ``bins[f, row]``, all rows get a value and those of a bag decide the splits."""

    def __init__(self, bins: np.ndarray, depth: int, least: int, draw: str, width: int):
        self.bins, self.depth, self.least, self.width = bins, depth, least, width
        self.columns = bins.shape[0]
        self.drawn = self.columns if draw == "all" else max(1, min(self.columns, math.ceil(float(draw) * self.columns)))

    def _gain(self, left, sum_left, n, s, least_gain):
        """Gain of splits that put ``left`` rows of sum ``sum_left`` of a node's ``n, s`` on one side; 0 where it may not be."""
        right, sum_right = n - left, s - sum_left
        gain = sum_left ** 2 / np.maximum(left, 1) + sum_right ** 2 / np.maximum(right, 1) - s * s / n
        gain[(left < self.least) | (right < self.least) | (gain <= least_gain)] = 0.0
        return gain

    def _undrawn(self, nodes: int, rng: np.random.Generator) -> np.ndarray | None:
        """The columns that each node may not split by."""
        if self.drawn == self.columns:
            return None
        order = rng.random((nodes, self.columns))
        return order > np.partition(order, self.drawn - 1, axis=1)[:, self.drawn - 1:self.drawn]

    def _by_bins(self, node, weight, y, n, s, least_gain, binned, undrawn):
        """(gain, column, bin) of the best split of each node, from sums by bin."""
        nodes, width = len(n), self.width
        size = nodes * width
        count, total = np.empty((nodes, self.columns, width)), np.empty((nodes, self.columns, width))
        first = node * width
        for f in range(self.columns):
            key = first + binned[f]
            count[:, f] = np.bincount(key, weight, size).reshape(nodes, width)
            total[:, f] = np.bincount(key, y, size).reshape(nodes, width)
        gain = self._gain(np.cumsum(count, axis=2)[:, :, :-1], np.cumsum(total, axis=2)[:, :, :-1],
                          *(v[:, None, None] for v in (n, s, least_gain)))
        if undrawn is not None:
            gain[undrawn] = 0.0
        flat = gain.reshape(nodes, -1)
        at = flat.argmax(axis=1)
        return flat[np.arange(nodes), at], at // (width - 1), at % (width - 1)

    def _by_rows(self, node, weight, y, n, s, least_gain, binned, undrawn, order):
        """The same from running sums over the rows of each node, for nodes of few rows; ``order`` has the rows by bin, for each column."""
        by_node = np.argsort(node[order].astype(np.int16 if len(n) < 2 ** 15 else np.int64), axis=1, kind="stable")
        at = np.take_along_axis(order, by_node, axis=1)
        each = np.sort(node)  # the node of each place, the same in every column
        starts = np.searchsorted(each, np.arange(len(n)))
        left = np.cumsum(np.ones(at.shape) if weight is None else weight[at], axis=1)
        sums = np.cumsum(y[at], axis=1)
        for running in (left, sums):
            before = np.concatenate([np.zeros((self.columns, 1)), running[:, starts[1:] - 1]], axis=1)
            running -= before[:, each]
        gain = self._gain(left, sums, n[each], s[each], least_gain[each])
        bins = np.take_along_axis(binned, at, axis=1)
        gain[:, :-1][(bins[:, 1:] == bins[:, :-1]) | (each[1:] != each[:-1])] = 0.0
        gain[:, -1] = 0.0
        if undrawn is not None:
            gain[undrawn.T[:, each]] = 0.0
        best = np.maximum.reduceat(gain, starts, axis=1)
        column = best.argmax(axis=0)
        most = best[column, np.arange(len(n))]
        place = np.full(len(n), len(each))
        hit = np.flatnonzero((gain[column[each], np.arange(len(each))] == most[each]) & (most[each] > 0))
        np.minimum.at(place, each[hit], hit)
        place = np.minimum(place, len(each) - 1)
        return most, column, bins[column, place]

    def tree(self, bag: np.ndarray, weight: np.ndarray | None, y: np.ndarray, rng: np.random.Generator, by_column: np.ndarray) -> np.ndarray:
        """Value of every row; gains are added to ``by_column``.  ``weight`` and ``y`` are those of the rows in ``bag``."""
        every = self.bins.shape[1]
        out, node, rows = np.zeros(every), np.zeros(every, np.int64), np.arange(every)
        y = y if weight is None else y * weight
        nodes, binned, order = 1, self.bins[:, bag], None
        noise = 1e-10 * np.mean(y * y)
        for level in range(self.depth + 1):
            in_bag = node[bag]
            n, s = np.bincount(in_bag, weight, nodes), np.bincount(in_bag, y, nodes)
            mean = s / n
            if level == self.depth:
                out[rows] = mean[node[rows]]
                break
            found = (in_bag, weight, y, n, s, noise * n, binned, self._undrawn(nodes, rng))
            if nodes * self.width <= len(bag):
                gain, column, cut = self._by_bins(*found)
            else:
                order = np.argsort(binned.astype(np.int16), axis=1, kind="stable") if order is None else order
                gain, column, cut = self._by_rows(*found, order)
            split = gain > 0
            by_column += np.bincount(column[split], gain[split], self.columns)
            if not split.all():
                on = split[node[rows]]
                out[rows[~on]] = mean[node[rows[~on]]]
                rows, keep = rows[on], split[in_bag]
                bag, y, binned = bag[keep], y[keep], binned[:, keep]
                weight = None if weight is None else weight[keep]
                if order is not None:
                    order = (np.cumsum(keep) - 1)[order[keep[order]]].reshape(self.columns, -1)
            if not len(rows):
                break
            old = node[rows]
            node[rows] = 2 * (np.cumsum(split) - 1)[old] + (self.bins[column[old], rows] > cut[old])
            nodes = 2 * int(split.sum())
        return out


def grow(x: np.ndarray, y: np.ndarray, later: np.ndarray, kind: str, params: dict, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(forecasts of the rows ``later``, importance of each column) of a model of the rows ``x, y``."""
    p = {**DEFAULTS[kind], **params}
    limits = [cuts(c, p["maxBins"] - 1) for c in x.T]
    width = max(2, 1 + max(map(len, limits)))
    bins = np.array([np.searchsorted(c, np.concatenate([a, b])) for c, a, b in zip(limits, x.T, later.T)], np.int64)
    grower = _Grower(bins, p["maxDepth"], p["minInstancesPerNode"], p["featureSubsetStrategy"], width)
    rows, rng, importance = len(y), np.random.default_rng(seed), np.zeros(x.shape[1])
    rate, all_rows = p["subsamplingRate"], np.arange(rows)
    if kind == "boost":
        so_far = np.zeros(bins.shape[1])
        for i in range(p["maxIter"]):
            bag = all_rows if rate >= 1 else np.flatnonzero(rng.random(rows) < rate)
            bag = bag if len(bag) else all_rows
            rest = 2 * (y - so_far[:rows]) if i else y
            so_far += grower.tree(bag, None, rest[bag], rng, importance) * (p["stepSize"] if i else 1.0)
        found = so_far
    else:
        found = np.zeros(bins.shape[1])
        for _ in range(p["numTrees"]):
            drawn = rng.poisson(rate, rows) if p["bootstrap"] else rng.random(rows) < rate
            bag = np.flatnonzero(drawn)
            bag, drawn = (bag, drawn) if len(bag) else (all_rows, np.ones(rows))
            own = np.zeros_like(importance)
            found += grower.tree(bag, drawn[bag].astype(float), y[bag], rng, own)
            importance += own / (own.sum() or 1.0)
        found /= p["numTrees"]
    return found[rows:], importance / (importance.sum() or 1.0)


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    whole = pa.concat_arrays(vectors.chunks).flatten().to_numpy(zero_copy_only=False)
    return whole.reshape(len(vectors), -1)


def fitter(models: list[tuple[str, str, dict]], seed: int, importances: list[str] | None = None):
    """The work of a task on rows ``job, learn, series, t, x, label, ...``: forecasts of the rows that are not for learning.

    ``models`` has ``(name, kind, settings)`` of each job.  With ``importances``, names of columns, the task returns their importances.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        jobs = table["job"].to_numpy()
        for job in np.unique(jobs):
            name, kind, params = models[job]
            own = table.filter(pa.array(jobs == job))
            learn = own["learn"].to_numpy()
            past, days = own.filter(pa.array(learn)), own.filter(pa.array(~learn))
            if not days.num_rows and not importances:
                continue
            x, y = _matrix(past["x"]), past["label"].to_numpy()
            order = np.lexsort([*x.T, y, past["series"].to_numpy(), past["t"].to_numpy()])
            later = _matrix(days["x"]) if days.num_rows else np.empty((0, x.shape[1]))
            found, weights = grow(x[order], y[order], later, kind, params, seed)
            if importances:  # of the whole fit, no day is forecast
                yield pa.RecordBatch.from_pydict({"name": importances, "value": weights})
                continue
            out = pa.table({"series_id": days["series_id"], "date": days["date"], "model": pa.array([name] * days.num_rows, pa.string()),
                            "forecast": found * days["scale"].to_numpy(), "actual": days["actual"]})
            yield from out.combine_chunks().to_batches()
    return work
