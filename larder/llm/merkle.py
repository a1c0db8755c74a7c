"""A Merkle manifest of a table in van Emde Boas layout.

Every row is a leaf; the leaves of a source, in order of their ids, form a tree of fan-out 16, and the subroots of all sources form
one more above.  A tree is stored in blocks: aligned subtrees of ``LEVELS`` levels above their lowest nodes.  The digests of a
block lie in one array in van Emde Boas order: the block is split at half its height into a top subtree and the bottom subtrees below
it, each laid out in the same way, so that a path from a leaf to the root meets few stretches of the array whatever
the size of a cache line.  The address of a node follows from its depth and index alone; building a block and finding the siblings of a
leaf use the same addresses.  The roots of blocks are the leaves of the next tier, until one block holds the rest.

A task holds one block at a time, a source of any size is spread over its blocks, and the way from a block's root to the root of
all travels once for a block, not for a leaf.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import stored
from larder.llm.ranks import ranked

FAN, LEVELS = 16, 3
_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_A_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes of a digest, signs of its text.
_RAW, _HEX = 32, 64


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def nodes_of(height: int) -> int:
    """Nodes of a full tree of so many levels."""
    return (FAN ** height - 1) // (FAN - 1)


def address(depth: int, index: int, height: int) -> int:
    """Place of a node (depth from the root, index in its level) in the van Emde Boas order of a tree of ``height`` levels."""
    if height == 1:
        return 0
    top = height // 2
    if depth < top:
        return address(depth, index, top)
    below = FAN ** (depth - top)
    subtree, rest = divmod(index, below)
    return nodes_of(top) + subtree * nodes_of(height - top) + address(depth - top, rest, height - top)


@cache
def _addresses(depth: int, height: int) -> list[int]:
    """The addresses of a whole level."""
    return [address(depth, i, height) for i in range(FAN ** depth)]


def raised(total: int, most: int = LEVELS) -> int:
    """Levels above the lowest, ``most`` at most, that a block has in a tree of ``total`` lowest nodes."""
    levels = 0
    while FAN ** levels < total and levels < most:
        levels += 1
    return levels


def build(leaves: list[str], height: int) -> list[str]:
    """All digests of one block, in van Emde Boas order; "" where the last, shorter block has no node."""
    places = _addresses(height - 1, height)[:len(leaves)]
    layout = [""] * (max(places) + 1)
    for place, leaf in zip(places, leaves, strict=True):
        layout[place] = leaf
    n = len(leaves)
    for depth in range(height - 2, -1, -1):
        own, under = _addresses(depth, height), _addresses(depth + 1, height)
        for i in range(-(-n // FAN)):
            layout[own[i]] = digest("".join(layout[a] for a in under[i * FAN:min(n, (i + 1) * FAN)]))
        n = -(-n // FAN)
    return layout


def siblings(layout: list[str], n: int, index: int, height: int) -> Iterator[tuple[str, str]]:
    """Digests left and right of the way from lowest node ``index`` of ``n`` to the block's root, level by level."""
    for depth in range(height - 1, 0, -1):
        places = _addresses(depth, height)
        first = index - index % FAN
        yield ("".join(layout[a] for a in places[first:index]), "".join(layout[a] for a in places[index + 1:min(n, first + FAN)]))
        index, n = index // FAN, -(-n // FAN)


def _packed(layout: list[str]) -> bytes:
    return b"".join(bytes.fromhex(x) if x else bytes(_RAW) for x in layout)


def _unpacked(raw: bytes) -> list[str]:
    text = bytes(raw).hex()
    return [text[i:i + _HEX] for i in range(0, len(text), _HEX)]


def _blocks(nodes: DataFrame, levels: int) -> DataFrame:
    """(tree, blk, total, n, layout, top): the blocks of one tier from its nodes (tree, pos, total, digest)."""
    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        total = int(pdf["total"].iloc[0])
        layout = build([bytes(x).hex() for x in pdf["digest"]], raised(total, levels) + 1)
        return pd.DataFrame({"tree": pdf["tree"].iloc[:1], "blk": pdf["blk"].iloc[:1], "total": [total], "n": [len(pdf)],
                             "layout": [_packed(layout)], "top": [bytes.fromhex(layout[0])]})

    grouped = nodes.select("tree", F.floor(F.col("pos") / FAN ** levels).alias("blk"), "pos", "total", "digest").groupBy("tree", "blk")
    return grouped.applyInPandas(one, "tree string, blk long, total long, n long, layout binary, top binary")


def tiers(nodes: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """The stored blocks of all trees, lowest tier first; a tree of one block ends in the lowest."""
    out, block = [], FAN ** levels
    most = nodes.agg(F.max("total")).first()[0]
    while most is not None:
        blocks = stored(_blocks(nodes, levels), "blocks")
        out.append(blocks)
        if most <= block:
            break
        nodes = blocks.filter(F.col("total") > block).select(
            "tree", F.col("blk").alias("pos"), F.ceil(F.col("total") / block).alias("total"), F.col("top").alias("digest"))
        most = -(-most // block)
    return out


def tops(tables: list[DataFrame], levels: int = LEVELS) -> DataFrame:
    """(tree, top): the root of each tree."""
    out = None
    for blocks in tables:
        ends = blocks.filter(F.col("total") <= FAN ** levels).select("tree", "top")
        out = ends if out is None else out.unionByName(ends)
    return out


_WAY = "left array<string>, right array<string>, subroot string, root string"


def _children(blocks: DataFrame, levels: int) -> DataFrame:
    """(tree, pos, way): from blocks with the way above them, the way above each of their lowest nodes."""
    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        layout, n, height = _unpacked(r["layout"]), int(r["n"]), raised(int(r["total"]), levels) + 1
        ways = [list(siblings(layout, n, i, height)) for i in range(n)]
        return pd.DataFrame({
            "tree": [r["tree"]] * n, "pos": [int(r["blk"]) * FAN ** levels + i for i in range(n)],
            "left": [[a for a, _ in w] + list(r["left"]) for w in ways], "right": [[b for _, b in w] + list(r["right"]) for w in ways],
            "subroot": [r["subroot"]] * n, "root": [r["root"]] * n})

    return blocks.groupBy("tree", "blk").applyInPandas(one, f"tree string, pos long, {_WAY}")


def _with_ways(tables: list[DataFrame], above: DataFrame, levels: int) -> DataFrame:
    """The lowest tier's blocks with the way from each block's root to the root of all.

    ``above`` (tree, left, right, subroot, root) is the way from each tree's root upwards.
    """
    children, block = None, FAN ** levels
    for blocks in reversed(tables):
        ends = blocks.filter(F.col("total") <= block).join(
            above.withColumnRenamed("tree", "__t"), F.col("tree").eqNullSafe(F.col("__t"))).drop("__t")
        if children is not None:
            way = children.select(F.col("tree").alias("__t"), F.col("pos").alias("__p"), "left", "right", "subroot", "root")
            ends = ends.unionByName(blocks.filter(F.col("total") > block).join(
                way, F.col("tree").eqNullSafe(F.col("__t")) & (F.col("blk") == F.col("__p"))).drop("__t", "__p"))
        if blocks is tables[0]:
            return ends
        children = _children(ends, levels)
    return None


def _coded(c: Column) -> Column:
    """A value as text with its length in bytes, ``-`` for null."""
    text = c.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[_coded(v) for v in values]), 256))


@dataclass
class Manifest:
    """Stored tables of a manifest."""

    leaves: DataFrame  # id, tree, digest, tampered, pos, total
    trees: list[DataFrame]  # blocks of the sources' trees by tier
    sources: DataFrame  # tree, pos, total, digest: the subroots
    above: list[DataFrame]  # blocks of the tree of subroots
    levels: int


def manifest(docs: DataFrame, fields: tuple[str, ...] = _FIELDS, tampered: Column | None = None,
             levels: int = LEVELS) -> Manifest:
    """The manifest of a table: its first field is the id, its second the source.

    Leaves of a source ascend by id (nulls first; rows of one id by their digests), sources by their bytes, null first.
    Blocks hold ``levels`` levels above their lowest nodes.  ``tampered`` may give other values of the last field, to be verified against the manifest; null where there are none.
    """
    own = [F.col(f) for f in fields]
    other = F.lit(None).cast("binary") if tampered is None else F.when(tampered.isNotNull(), leaf(*own[:-1], tampered))
    rows = docs.select(own[0].alias("id"), own[1].cast("string").alias("tree"), leaf(*own).alias("digest"), other.alias("tampered"))
    # written first: ranking reads its input twice, and the texts should be read once
    leaves = ranked(stored(rows, "leaves"), "tree", ["id", "digest"])
    trees = tiers(leaves.select("tree", "pos", "total", "digest"), levels)
    roots = tops(trees, levels) if trees else rows.select("tree", F.col("digest").alias("top")).limit(0)
    sources = ranked(roots.select("tree", F.col("top").alias("digest"), F.lit("").alias("all")), "all", ["tree"])
    above = tiers(sources.select(F.col("all").alias("tree"), "pos", "total", "digest"), levels)
    return Manifest(leaves, trees, sources, above, levels)


def proofs(m: Manifest, name: str = "doc_id") -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) for every leaf of a manifest.

    The proof of a leaf is the digests beside its way to the root, level by level.  ``folded_root`` is recomputed from the tampered
    leaf, or the leaf itself where nothing is tampered with, and the proof.  An empty table gives no rows.
    """
    import pandas as pd

    levels = m.levels
    kind = m.leaves.schema["id"].dataType.simpleString()
    schema = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if not m.trees:
        return m.leaves.sparkSession.createDataFrame([], f"`{name}` {kind}, {schema}")
    top = tops(m.above, levels).select("tree", F.lit(None).cast("string").alias("subroot"), F.lower(F.hex("top")).alias("root"))
    nothing = F.array().cast("array<string>")
    ways = _children(_with_ways(m.above, top.select("tree", nothing.alias("left"), nothing.alias("right"), "subroot", "root"), levels), levels)
    above = m.sources.select(F.col("tree"), F.col("pos"), F.lower(F.hex("digest")).alias("subroot")).join(
        ways.select("pos", "left", "right", "root"), "pos").select("tree", "left", "right", "subroot", "root")
    blocks = _with_ways(m.trees, stored(above, "ways"), levels)

    def prove(leaves: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        r = block.iloc[0]
        layout, n, height = _unpacked(r["layout"]), int(r["n"]), raised(int(r["total"]), levels) + 1
        upper = list(zip(r["left"], r["right"], strict=True))
        memory: dict[tuple[int, int, str], str] = {}
        tails: dict[int, tuple[list[tuple[str, str]], str]] = {}

        def folded(way: list[tuple[str, str]], run: int, level: int, value: str) -> str:
            """The root from a node's digest and what lies beside its way; equal work is done once."""
            if level == len(way):
                return value
            key = (run, level, value)
            if key not in memory:
                memory[key] = folded(way, run, level + 1, digest(way[level][0] + value + way[level][1]))
            return memory[key]

        out = []
        for pos, own, other in zip(leaves["pos"], leaves["digest"], leaves["tampered"], strict=True):
            index = int(pos) % FAN ** levels
            run = index // FAN
            way = [*siblings(layout, n, index, height), *upper] if height > 1 else upper
            if height > 1:
                if run not in tails:
                    tails[run] = (way[1:], "".join(a + b for a, b in way[1:]))
                rest, tail = tails[run]
                a, b = way[0]
                proof = digest(a + b + tail)
            else:
                rest, a, b, proof = upper, "", "", digest("".join(x + y for x, y in upper))
            start = bytes(own if other is None else other).hex()
            at = folded(rest, run, 0, digest(a + start + b)) if height > 1 else folded(rest, run, 0, start)
            out.append((bytes(own).hex(), r["subroot"], r["root"], proof, at, at == r["root"]))
        result = pd.DataFrame(out, columns=["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])
        result.insert(0, name, leaves["id"].to_list())
        return result

    # as text, since pandas has no whole numbers with nulls
    rows = m.leaves.select(F.col("id").cast("string").alias("id"), "tree", F.floor(F.col("pos") / FAN ** levels).alias("blk"), "pos", "digest", "tampered")
    pairs = rows.groupBy("tree", "blk").cogroup(blocks.groupBy("tree", "blk"))
    proved = pairs.applyInPandas(prove, f"`{name}` string, {schema}")
    return proved.withColumn(name, F.col(f"`{name}`").cast(kind))


def digests(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Proof and verification of every row of ``documents``, a fifth of them tampered with: A-Z of their texts are lower case.

    Null fields have a code of their own, so a null text differs from an empty one; a null source is a source; a row with a null id is not
    tampered with.  Equal rows are leaves side by side.  Other columns are not read.
    """
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return proofs(manifest(docs, _FIELDS, F.when(chosen, F.translate("text", _A_Z, _A_Z.lower())), levels))


#: Levels that the SQL has, for up to FAN ** 7 leaves a source and as many sources.
_SQL_LEVELS = 7


def _sql_levels(name: str, steps: list[str]) -> None:
    """CTEs ``name``0.. of the levels (tree, idx, h, n) of trees, each from the one below it; n is the level's number of nodes."""
    for k in range(1, _SQL_LEVELS + 1):
        steps.append(f"""{name}{k} AS (SELECT tree, idx // {FAN} AS idx, sha256(string_agg(h, '' ORDER BY idx)) AS h, any_value((n + {FAN - 1}) // {FAN}) AS n
    FROM {name}{k - 1} WHERE n > 1 GROUP BY tree, idx // {FAN})""")


def _sql_ways(name: str, start: str, keep: str, steps: list[str]) -> str:
    """CTEs that carry (tree, idx, at, proof) up the levels of ``name``; gives the name of the last."""
    last = start
    for k in range(_SQL_LEVELS):
        steps.append(f"""{name}w{k} AS (SELECT {', '.join(f'w.{c}' for c in keep.split())}, w.tree, w.idx // {FAN} AS idx,
    CASE WHEN count(s.h) = 0 THEN any_value(w.at) ELSE sha256(string_agg(CASE WHEN s.idx = w.idx THEN w.at ELSE s.h END, '' ORDER BY s.idx)) END AS at,
    any_value(w.proof) || coalesce(string_agg(s.h, '' ORDER BY s.idx) FILTER (s.idx <> w.idx), '') AS proof
    FROM {last} w LEFT JOIN {name}{k} s ON s.tree IS NOT DISTINCT FROM w.tree AND s.idx // {FAN} = w.idx // {FAN} AND s.n > 1
    GROUP BY {', '.join(f'w.{c}' for c in keep.split())}, w.tree, w.idx)""")
        last = f"{name}w{k}"
    return last


def sql() -> str:
    """The query on ``documents`` in DuckDB, level by level."""
    def coded(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    head = " || ".join(coded(f) for f in _FIELDS[:-1])
    crc = ("xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)), "
           "lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), "
           "lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))")
    steps = [f"""coded AS (SELECT doc_id, source AS tree, sha256({head} || {coded('text')}) AS h,
    CASE WHEN doc_id IS NOT NULL AND {crc} % 5 = 0 AND text IS NOT NULL THEN sha256({head} || {coded(f"translate(text, '{_A_Z}', '{_A_Z.lower()}')")}) END AS other FROM documents)""",
             """placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n,
    row_number() OVER () AS id FROM coded)""",
             "l0 AS (SELECT tree, idx, h, n FROM placed)"]
    _sql_levels("l", steps)
    tops = " UNION ALL ".join(f"SELECT tree, h FROM l{k} WHERE n = 1" for k in range(_SQL_LEVELS + 1))
    steps += [f"tops AS ({tops})",
              "t0 AS (SELECT '' AS tree, tree AS source, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS idx, h, count(*) OVER () AS n FROM tops)"]
    _sql_levels("t", steps)
    root = " UNION ALL ".join(f"SELECT h FROM t{k} WHERE n = 1" for k in range(_SQL_LEVELS + 1))
    steps += [f"top AS ({root})", "start AS (SELECT id, tree, idx, coalesce(other, h) AS at, '' AS proof FROM placed)"]
    last = _sql_ways("l", "start", "id", steps)
    steps.append(f"mid AS (SELECT w.id, '' AS tree, t0.idx, w.at, w.proof, t0.h AS subroot FROM {last} w JOIN t0 ON w.tree IS NOT DISTINCT FROM t0.source)")
    last = _sql_ways("t", "mid", "id subroot", steps)
    body = ",\n".join(steps)
    return f"""WITH {body}
SELECT doc_id, p.h AS leaf, subroot, top.h AS root, sha256(proof) AS proof_sha256, w.at AS folded_root, w.at = top.h AS verified
FROM {last} w JOIN placed p USING (id) CROSS JOIN top"""
