"""Nearest neighbours by a forest of hash prefixes.

Each of ``TREES`` trees gives every vector a string of 64 bits (the sides of random hyperplanes) and keeps the
vectors in a sorted array of these strings, which is the tree: a node is a prefix, its
leaves a range of the array.  A query descends in each tree to its longest matching prefixes; then all trees ascend in step,
one bit shorter at a time, until their ranges together hold ``NEAR`` candidates a tree.  These are
scored exactly.  No prefix length is fixed beforehand: dense regions are searched deep, sparse ones near the root.

The table is dealt into blocks by a hash of the id; each block has its forest and meets the stated queries in
chunks, so a task holds ``BLOCK`` vectors and ``CHUNK`` queries however large both are, and gives
``k`` rows for each query.  These are merged with a partial aggregate.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TREES, BITS, NEAR = 128, 64, 24
BLOCK, CHUNK = 8192, 4096


class Forest:
    """Sorted hash strings of a block, one array for each tree."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES, seed: int = 1):
        self.planes = np.random.default_rng(seed).standard_normal((trees, vectors.shape[1], BITS))
        self.order, self.strings = [], []
        for plane in self.planes:
            strings = self._strings(vectors, plane)
            order = np.argsort(strings, kind="stable")
            self.order.append(order)
            self.strings.append(strings[order])

    @staticmethod
    def _strings(vectors: np.ndarray, plane: np.ndarray) -> np.ndarray:
        return np.packbits(vectors @ plane > 0, axis=1).view(">u8").ravel().astype(np.uint64)

    def _ranges(self, own: list[np.ndarray], length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each tree and query the range that shares the first ``length`` bits."""
        rest = np.where(length == 0, ~np.uint64(0), (np.uint64(1) << (np.uint64(BITS) - np.maximum(length, 1).astype(np.uint64))) - np.uint64(1))
        low = np.stack([np.searchsorted(s, q & ~rest, "left") for s, q in zip(self.strings, own, strict=True)])
        high = np.stack([np.searchsorted(s, q | rest, "right") for s, q in zip(self.strings, own, strict=True)])
        return low, high

    def candidates(self, queries: np.ndarray, near: int = NEAR) -> tuple[np.ndarray, np.ndarray]:
        """(query, vector) pairs, each once: where the trees stand when they ascended in step far enough."""
        own = [self._strings(queries, p) for p in self.planes]
        # the longest common prefix length at which the ranges hold enough, by bisection: ranges only grow on the way up
        good, bad = np.zeros(len(queries), np.int64), np.full(len(queries), BITS + 1)
        while (bad - good > 1).any():
            middle = (good + bad) // 2
            low, high = self._ranges(own, middle)
            enough = (high - low).sum(0) >= near * len(self.planes)
            good, bad = np.where(enough, middle, good), np.where(enough, bad, middle)
        low, high = self._ranges(own, good)
        seen = np.zeros((len(queries), len(self.order[0])), bool)
        for a, b, order in zip(low, high, self.order, strict=True):
            count = b - a
            at = np.repeat(a - np.cumsum(count) + count, count) + np.arange(count.sum())
            seen[np.repeat(np.arange(len(queries)), count), order[at]] = True
        return np.nonzero(seen)


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of pairs in double precision, each from its own two rows alone."""
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def _search(k: int, trees: int, near: int, seed: int):
    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        asked = pdf["asks"].to_numpy()
        out = []
        if asked.any() and not asked.all():
            vectors, queries = (np.stack(pdf.loc[m, "v"].to_list()).astype(np.float64) for m in (~asked, asked))
            ids, names = pdf.loc[~asked, "id"].to_numpy(), pdf.loc[asked, "id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, vectors = ids[order], vectors[order]
            forest = Forest(vectors, trees, seed)
            for a in range(0, len(queries), 32):
                q, c = forest.candidates(queries[a:a + 32], near)
                apart = names[a + q] != ids[c]
                q, c = q[apart], c[apart]
                score = _cosine(queries[a + q], vectors[c])
                first = np.lexsort((ids[c], -score, q))
                q, c, score = q[first], c[first], score[first]
                once = ~pd.DataFrame({"q": q, "c": ids[c]}).duplicated().to_numpy()
                q, c, score = q[once], c[once], score[once]
                starts = np.searchsorted(q, np.arange(len(q) and q[-1] + 1))
                top = np.arange(len(q)) - starts[q] < k if len(q) else np.zeros(0, bool)
                out.append(pd.DataFrame({"query_id": names[a + q[top]], "vec_id": ids[c[top]], "score": score[top]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    return search


def usable(vector: str) -> Column:
    """Whether a vector is not null, not zero, and has finite components only."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def nearest(table: DataFrame, asks: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding",
            trees: int = TREES, near: int = NEAR, seed: int = 1) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for every row where ``asks`` holds, among all other rows.

    Nearness is the cosine.  Rows that repeat an id count once, by their best score; a query is not its own neighbour.
    Rows with a null id, and vectors that are null, zero or not finite take no part.  Vectors of other lengths are never compared.
    """
    rows = table.filter(F.col(vec_id).isNotNull() & usable(vector)).select(
        F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), asks.alias("asks"), F.size(vector).alias("n"))
    total, asked = rows.agg(F.count("*"), F.count_if("asks")).first()
    blocks, chunks = max(1, -(-total // BLOCK)), max(1, -(-asked // CHUNK))
    block, chunk = F.pmod(F.xxhash64("id"), F.lit(blocks)), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(chunks))

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    stored_side = rows.select("id", "v", "n", F.lit(False).alias("asks"), block.alias("block"), every(chunks).alias("chunk"))
    asking_side = rows.filter("asks").select("id", "v", "n", "asks", every(blocks).alias("block"), chunk.alias("chunk"))
    found = stored_side.unionByName(asking_side).groupBy("n", "block", "chunk").applyInPandas(
        _search(k, trees, near, seed), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
