"""SimHash near-duplicates by a hierarchical index over fingerprints in Gray order.

A fingerprint has a bit set if over half of the document's shingle hashes have it.
Fingerprints that differ in few bits are linked, and links close into groups.

The index of a block of distinct fingerprints sorts them by Gray rank, so that
neighbours differ in few bits, and cuts the order into groups, groups of groups,
and so on.  A node keeps the bits that all fingerprints below it share and
its parent does not already hold (a mask and the pattern under it).  A search
adds up differences from the top; a node whose sum exceeds the bound falls with all
below it.  A node whose members already lie in the searcher's own group falls too,
so a dense group of near copies costs no pair for each of its pairs.

Blocks come from the pigeonhole rule: of ``m`` bit segments at most ``bits`` can
differ, so each choice of ``m - bits`` segments becomes a copy of the
table, grouped by the values in the chosen segments.  ``m`` follows from the number of distinct
fingerprints so that blocks stay small; a block that is large all the same is split into pairs
of parts, each pair a block of its own.  No link is lost and none is approximate.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import consecutive, lean, matching_rows, partitions_for, row_keys, stored, words
from larder.llm.components import components

#: Mean and largest number of fingerprints in a block.
MEAN_BLOCK, LARGEST_BLOCK = 2048, 32768
FANOUT = 16


def simhash(text: str | None, shingle: int = 4) -> int:
    """Fingerprint of one text as a signed 64-bit number; 0 without words.

    A-Z count as a-z.  A text of fewer words than a shingle is one shingle.
    """
    tokens = words(text.encode().lower()) if text else []
    if not tokens:
        return 0
    digest = xxhash.xxh64_intdigest
    last = max(1, len(tokens) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for a in range(0, last, 1 << 16):
        hashes = [digest(b" ".join(tokens[i:i + shingle]), 42) for i in range(a, min(last, a + (1 << 16)))]
        packed = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(packed, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > last, bitorder="little").view("<i8")[0])


def fingerprint(text: str, shingle: int = 4) -> Column:
    @F.pandas_udf("long")
    def column(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, shingle) for t in texts], dtype="int64")
    return column(text)


def hexadecimal(column: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Position of each 64-bit value in the reflected Gray code."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Tree over distinct fingerprints; ``star`` gives edges that connect all linked ones."""

    def __init__(self, values: np.ndarray, bits: int):
        self.values = values[np.argsort(gray_rank(values), kind="stable")]
        self.bits = bits
        self.levels = []  # from the leaves up: start of each node, pattern, mask, mask without the parent's
        starts, pattern = np.arange(len(values)), self.values
        mask = np.full(len(values), ~np.uint64(0))
        while len(starts) > FANOUT:
            first = np.arange(0, len(starts), FANOUT)
            differ = np.bitwise_or.reduceat(pattern ^ np.repeat(pattern[first], np.diff([*first, len(starts)])), first)
            shared = np.bitwise_and.reduceat(mask, first) & ~differ
            self.levels.append((starts, pattern, mask & ~np.repeat(shared, np.diff([*first, len(starts)]))))
            starts, pattern, mask = starts[first], pattern[first], shared
        self.levels.append((starts, pattern, mask))

    def _uniform(self, label: np.ndarray) -> list[np.ndarray]:
        """For each level the label that all members of a node share, or -1."""
        found = []
        for starts, _, _ in self.levels:
            low, high = np.minimum.reduceat(label, starts), np.maximum.reduceat(label, starts)
            found.append(np.where(low == high, low, -1))
        return found

    def _pairs(self, a: int, b: int, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Linked (i, j), i in [a, b) and j > i, that are not yet in one group."""
        uniform = self._uniform(label)
        top = len(self.levels) - 1
        width = len(self.levels[top][0])
        query = np.repeat(np.arange(a, b), width)
        node = np.tile(np.arange(width), b - a)
        total = np.zeros(len(query), np.uint8)
        for level in range(top, -1, -1):
            starts, pattern, mask = self.levels[level]
            total = total + np.bitwise_count((self.values[query] ^ pattern[node]) & mask[node])
            ends = np.append(starts[1:], len(self.values))
            keep = (total <= self.bits) & (ends[node] > query + 1) & (uniform[level][node] != label[query])
            query, node, total = query[keep], node[keep], total[keep]
            if level and len(node):
                below = len(self.levels[level - 1][0])
                first = node * FANOUT
                count = np.minimum(first + FANOUT, below) - first
                query, total = np.repeat(query, count), np.repeat(total, count)
                node = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
        later = node > query
        return query[later], node[later]

    def star(self) -> tuple[np.ndarray, np.ndarray]:
        n, label = len(self.values), np.arange(len(self.values))
        near = np.bitwise_count(self.values[1:] ^ self.values[:-1]) <= self.bits
        label = np.maximum.accumulate(np.where(np.append(True, ~near), label, 0))
        step = 256 if n > 512 else n
        for a in range(0, n, step):
            i, j = self._pairs(a, min(n, a + step), label)
            if len(i):
                label = _merged(label, label[i], label[j])
        moved = np.nonzero(label != np.arange(n))[0]
        return self.values[moved], self.values[label[moved]]


def _merged(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Labels after joining the groups of each (left, right)."""
    parent: dict[int, int] = {}

    def root(x):
        while parent.get(x, x) != x:
            parent[x] = x = parent.get(parent[x], parent[x])
        return x
    for x, y in np.unique(np.stack([left, right]), axis=1).T.tolist():
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    to = np.arange(len(label))
    for x in parent:
        to[x] = root(x)
    return to[label]


def _segments(distinct: int, bits: int) -> list[list[tuple[int, int]]]:
    """The choices of segments, each a list of (shift, width), for so many distinct fingerprints."""
    for m in range(bits + 1, min(64, bits + 6)):
        cuts = [64 * i // m for i in range(m + 1)]
        if distinct >> min(62, (m - bits) * (64 // m)) <= MEAN_BLOCK:
            break
    spans = [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [list(c) for c in combinations(spans, m - bits)]


def _blocks(table: DataFrame, distinct: int, bits: int) -> DataFrame:
    """(block, fp): every fingerprint once for each choice of segments, parts of large blocks paired."""
    keys = []
    for number, chosen in enumerate(_segments(distinct, bits)):
        parts = [F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in chosen]
        keys.append(F.xxhash64(F.lit(number), *parts))
    # a clash of two keys puts two blocks together, which costs time but no link
    rows = table.select("fp", F.explode(F.array(*keys)).alias("block"))
    if distinct <= LARGEST_BLOCK:
        return rows
    large = (rows.groupBy("block").agg(F.count("*").alias("n")).filter(F.col("n") > LARGEST_BLOCK)
             .withColumn("parts", F.ceil(2 * F.col("n") / LARGEST_BLOCK).cast("int")).drop("n"))
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")).cast("int")
    other = F.sequence(F.lit(0), F.col("parts") - 1)
    pairs = F.transform(other, lambda b: F.xxhash64("block", F.least(own, b), F.greatest(own, b)))
    return rows.join(large, "block", "left").select(
        "fp", F.explode(F.when(F.col("parts").isNull(), F.array("block")).otherwise(pairs)).alias("block"))


def links(table: DataFrame, bits: int = 4) -> DataFrame:
    """Edges (u, v) over the distinct values of ``fp`` whose closure joins all values ``bits`` or fewer bits apart."""
    spark = table.sparkSession
    distinct = table.count()
    rows = _blocks(table, distinct, bits)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, group in consecutive(batches, "block"):
            if len(group) > 1:
                u, v = GrayIndex(np.unique(group["fp"].to_numpy().astype(np.int64).view(np.uint64)), bits).star()
                if len(u):
                    yield pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    tasks = partitions_for(distinct * 5, 100_000, spark)
    return rows.repartition(tasks, "block").sortWithinPartitions("block").mapInPandas(search, "u long, v long")


def _narrow(docs: DataFrame, shingle: int, text: str, doc_id: str) -> DataFrame:
    """(id, fp, k1, k2) of every row, written once: the fingerprints are the costly part."""
    lean(docs.sparkSession)
    keys = row_keys(doc_id, text)
    return stored(docs.select(F.col(doc_id).alias("id"), fingerprint(text, shingle).alias("fp"), *keys), "fingerprints")


def _component_of(narrow: DataFrame, bits: int) -> DataFrame:
    """Each distinct fingerprint as ``key`` with its component's root and least id."""
    classes = stored(narrow.groupBy("fp").agg(F.min("id").alias("id")), "classes")
    roots = components(links(classes.select("fp"), bits))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select(
        "fp", "id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    return rooted.join(least, "root").select(F.col("fp").alias("key"), "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 4, bits: int = 4, text: str = "text",
                    doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    The fingerprint is 16 hexadecimal digits; ``component_id`` is the smallest id reachable by links,
    the row's own included.  A null or empty text has fingerprint zero and is linked like any
    other.  A row with a null id takes part; a component of null ids only has a null
    ``component_id``.  Rows that repeat an id each get a row.  Other columns are not read.
    """
    narrow = _narrow(docs, shingle, text, doc_id)
    found = _component_of(narrow, bits)
    return narrow.join(found, narrow.fp == found.key, "left").select(
        F.col("id").alias(doc_id), hexadecimal("fp").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, shingle: int = 4, bits: int = 4, text: str = "text",
                    doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the least id (null last), then the least text hash.

    Of rows equal in id and text one stays.  All columns are kept, whatever their names.
    """
    narrow = _narrow(docs, shingle, text, doc_id)
    found = _component_of(narrow, bits)
    order = F.struct(F.col("id").isNull(), F.coalesce("id", F.lit(0)), "k1", "k2")
    kept = (narrow.join(found, narrow.fp == found.key).groupBy("root")
            .agg(F.min(order).alias("least")).select("least.k1", "least.k2"))
    return matching_rows(docs, kept, doc_id, text)
