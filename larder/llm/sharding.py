"""Shards of near equal bytes by a k-d tree over metadata.

The documents are the root's rows.  A node that is to become k shards is split along its widest metadata dimension at the weighted median (for
odd k the quantile floor(k / 2) / k of its bytes), until every leaf holds the bytes of one shard.  So a shard covers a box of metadata:
few sources, languages or lengths, and a reader can skip the others.

A median is found by counting: a node's range of keys is cut in ``BUCKETS`` equal steps, Spark sums the bytes of each step, and the
step that holds the median is cut again, until it holds one key.  All nodes of a depth are split in the same jobs, and a row's node is an expression
over its keys, so no row moves for a split; the driver sees one number for each step that has rows, at most BUCKETS for each node.

A key is the coordinate of a row in a dimension, in steps, and below it a hash of its group.  Equal texts are a group: they have the
coordinates of one of them and the same key, so that no split parts them; a group with more bytes than a share of a shard is divided by
ids into parts of about that share, each with a key of its own, as the sizes of shards come first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import stored
from larder.llm.ranks import ranked

SHARDS, OVERHEAD = 40, 16
#: Steps of a coordinate and values of a hash, in bits; steps of a range in one count; parts of a shard that a group may fill.
STEP_BITS, HASH_BITS, BUCKETS, PARTS = 24, 38, 1024, 64
#: Bytes of a name that order it.
_HEAD = 6


def _by_name(c: Column) -> Column:
    """A number in the order of the first bytes of a name; 0 for null."""
    head = F.rpad(F.hex(F.substring(F.encode(F.coalesce(c.cast("string"), F.lit("")), "UTF-8"), 1, _HEAD)), 2 * _HEAD, "0")
    return F.conv(head, 16, 10).cast("double")


def _by_magnitude(c: Column) -> Column:
    """The binary logarithm of a number, 0 for null and what is not above 0."""
    return F.log2(F.greatest(F.coalesce(c.cast("double"), F.lit(0.0)), F.lit(0.0)) + 1)


#: Metadata dimensions: columns of the table and how their values are laid on a line.
DIMENSIONS = (("source", _by_name), ("lang", _by_name), ("n_chars", _by_magnitude))


@dataclass
class Split:
    """A node of the tree: ``shards`` leaves from number ``first``; split at ``cut`` of ``dimension`` unless it is a leaf."""

    first: int
    shards: int
    dimension: int = -1
    cut: int = 0  # keys below it go left
    left: Split | None = None
    right: Split | None = None


def _node(node: Split) -> Column:
    """The number of the first shard of the deepest node that a row is in."""
    if node.left is None:
        return F.lit(node.first)
    return F.when(F.col(f"k{node.dimension}") < node.cut, _node(node.left)).otherwise(_node(node.right))


def _literal(values: dict[int, int]) -> Column:
    """The number of a row's node."""
    return F.element_at(F.create_map(*[F.lit(v) for n, x in values.items() for v in (n, x)]), F.col("node"))


def _cut(rows: DataFrame, nodes: list[Split], spans: dict[int, tuple[int, int]], total: dict[int, int]) -> None:
    """Sets the cut of every node; ``rows`` (node, key, size) are theirs, ``spans`` their least and largest keys, ``total`` their bytes.

    A cut lies between two keys, where the bytes below are nearest to the left side's share (the lower of two).  A node of one key has
    nothing on its left.
    """
    found: dict[int, list[tuple[int, int]]] = {n.first: [] for n in nodes}  # distance from the share and key
    below = dict.fromkeys(found, 0)
    open_ = {n.first: n for n in nodes if spans[n.first][0] < spans[n.first][1]}
    spans = dict(spans)
    while open_:
        low, high = ({n: spans[n][e] for n in open_} for e in (0, 1))
        steps = {n: (high[n] - low[n]) // BUCKETS + 1 for n in open_}
        inside = rows.filter(F.col("node").isin(list(open_))).withColumns({"low": _literal(low), "high": _literal(high), "step": _literal(steps)})
        counted = inside.filter("key BETWEEN low AND high").groupBy("node", F.expr("(key - low) div step").alias("at")).agg(
            F.sum("size").alias("bytes"), F.min("key").alias("least"), F.max("key").alias("most")).collect()
        by_node: dict[int, list] = {}
        for r in sorted(counted, key=lambda r: r.at):
            by_node.setdefault(r.node, []).append(r)
        for n, parts in by_node.items():
            share, of = total[n] * (open_[n].shards // 2), open_[n].shards
            done = below[n]
            for r in parts:
                if r.least > spans[n][0]:
                    found[n].append((abs(done * of - share), r.least))
                if (done + r.bytes) * of >= share:
                    break
                done += r.bytes
            after = parts[parts.index(r) + 1:]
            if after:
                found[n].append((abs((done + r.bytes) * of - share), after[0].least))
            below[n] = done
            if r.least == r.most:
                del open_[n]
            else:
                spans[n] = (r.least, r.most)
    for n in nodes:
        n.cut = min(found[n.first])[1] if found[n.first] else spans[n.first][0]


def grown(keyed: DataFrame, shards: int, dims: int) -> Split:
    """The tree over rows (size, k0, k1, ..): one job for the extents of a depth's nodes and a few for their medians."""
    root = Split(0, shards)
    level = [root] if shards > 1 else []
    while level:
        rows = keyed.withColumn("node", _node(root))
        extents = rows.filter(F.col("node").isin([n.first for n in level])).groupBy("node").agg(
            F.sum("size").alias("size"), *[f(f"k{d}").alias(f"{f.__name__}{d}") for d in range(dims) for f in (F.min, F.max)]).collect()
        of = {r.node: r for r in extents}
        level = [n for n in level if n.first in of]  # a node without rows has no leaves with rows
        for n in level:
            widths = [(of[n.first][f"max{d}"] >> HASH_BITS) - (of[n.first][f"min{d}"] >> HASH_BITS) for d in range(dims)]
            n.dimension = widths.index(max(widths))
        if level:
            spans = {n.first: (of[n.first][f"min{n.dimension}"], of[n.first][f"max{n.dimension}"]) for n in level}
            dimension = _literal({n.first: n.dimension for n in level})
            key = F.coalesce(*[F.when(dimension == d, F.col(f"k{d}")) for d in range(dims)])
            _cut(rows.filter(F.col("node").isin(list(spans))).select("node", key.alias("key"), "size"), level, spans,
                 {n: of[n]["size"] for n in spans})
        for n in level:
            n.left, n.right = Split(n.first, n.shards // 2), Split(n.first + n.shards // 2, n.shards - n.shards // 2)
        level = [c for n in level for c in (n.left, n.right) if c.shards > 1]
    return root


def keyed_rows(docs: DataFrame, shards: int = SHARDS, text: str = "text", doc_id: str = "doc_id", dimensions=DIMENSIONS) -> DataFrame:
    """(id, size, crc, k0, k1, ..): a stored row for every document with its keys in each dimension.  Texts are read once and do not travel."""
    full = F.coalesce(F.col(text), F.lit(""))
    names = [f"c{d}" for d in range(len(dimensions))]
    rows = stored(docs.select(
        F.col(doc_id).alias("id"), (F.octet_length(full) + OVERHEAD).cast("long").alias("size"), F.crc32(full.cast("binary")).alias("crc"),
        *[F.xxhash64(F.lit(n), full, F.lit(n)).alias(f"h{n}") for n in (1, 2)],
        *[lay(F.col(c)).alias(name) for name, (c, lay) in zip(names, dimensions, strict=True)]), "sizes")
    ends = rows.agg(F.sum("size").alias("total"), *[f(c).alias(f"{f.__name__}_{c}") for c in names for f in (F.min, F.max)]).first()
    part = max(1, (ends.total or 0) // (shards * PARTS))
    # a group of any number of copies comes combined from each task; written, so that the join has an exchange of its own on both sides and
    # the planner can split the rows of a very large group
    groups = stored(rows.groupBy("h1", "h2").agg(F.ceil(F.sum("size") / part).alias("parts"), *[F.min(c).alias(f"g_{c}") for c in names]), "groups")
    joined = rows.drop(*names).join(groups, ["h1", "h2"])
    own = F.shiftrightunsigned(F.xxhash64("h1", "h2", F.pmod(F.xxhash64("id"), F.col("parts"))), 64 - HASH_BITS)

    def key(c: str) -> Column:
        low, high = ends[f"min_{c}"] or 0.0, ends[f"max_{c}"] or 0.0
        at = F.floor((F.col(f"g_{c}") - F.lit(low)) / F.lit(max(high - low, 1e-300)) * F.lit(float((1 << STEP_BITS) - 1)))
        return F.shiftleft(at.cast("long"), HASH_BITS) + own
    return stored(joined.select("id", "size", "crc", *[key(c).alias(f"k{d}") for d, c in enumerate(names)]), "keys")


def sharded(docs: DataFrame, shards: int | None = SHARDS, target_bytes: int | None = None, text: str = "text", doc_id: str = "doc_id",
            dimensions=DIMENSIONS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row.

    ``size`` is the text's bytes and ``OVERHEAD``; ``shards`` or, if given, the least number that holds ``target_bytes`` a shard.  Slots
    count the rows of a shard from 0 by id (null first, then by content).  A null text counts as an empty one, its checksum is 0; null
    metadata lie at the lower end of their dimension.  Equal rows stay together unless their group is larger than a part of a shard;
    with fewer groups than shards some shards have no rows.  An empty table gives no rows.  Other columns are not read.
    """
    if target_bytes is not None:
        total = docs.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD)).first()[0] or 0
        shards = max(1, -(-total // target_bytes))
    keyed = keyed_rows(docs, shards, text, doc_id, dimensions)
    placed = keyed.select("id", "size", "crc", _node(grown(keyed, shards, len(dimensions))).cast("int").alias("shard"))
    return ranked(placed, "shard", ["id", "crc", "size"]).select(
        F.col("id").alias(doc_id), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        F.col("pos").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
