"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Every source gets a target: its share by weight of the words wanted, at most so many times
   its own words; what is over goes to the other sources by weight.
2. The documents of a source are cut into blocks of words and put in a random order that follows from a
   hash.  The first blocks up to the target are drawn, once more for each whole time the target holds the source.
   This fixes an exact quota of blocks for each source.
3. A tree splits the quotas among output shards.  A node holds how many blocks of each source lie below it; its left child
   gets a multivariate-hypergeometric draw of them, the right child the rest, down to one shard.  Each
   shard so gets its quotas as if all blocks had been shuffled together, without a global shuffle.
4. A shard takes the next unused places of each source's random order (so blocks are disjoint) and orders its own blocks at random.

All steps are DataFrame operations.  A source is divided into cells of its random order, by the number of rows, and only
sums over cells are ordered as a whole, so a source that holds most rows is spread like any other.
The tree has a row for each node, with an entry for each source.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larder.llm.common import n_words, row_keys, stored, uniform

#: Rows of a cell, on average, and blocks of a shard.
CELL, SHARD = 4096, 4096


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(source, i, source_size, target) from (source, source_size).

    Sources in code-point order, null last, take the weights in turn.  The targets add up to
    ``share`` times all words, unless every source is at ``most`` times its own.  One row for each source is ordered in one task.
    """
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = sizes.withColumn("i", F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1)
    rows = rows.withColumns({
        "w": F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("i") % len(weights) + 1).cast("int")),
        "top": F.col("source_size") * F.lit(float(most)), "all": F.sum("source_size").over(everything) * F.lit(float(share))})
    by_room = W.orderBy(F.col("top") / F.col("w"), "i")
    full = F.coalesce(F.sum("top").over(by_room.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.col("all") - full) / F.sum("w").over(by_room.rowsBetween(W.currentRow, W.unboundedFollowing))
    # the level rises while sources fill up and falls afterwards, so the right one is the highest
    rows = rows.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return rows.select("source", "i", "source_size", F.least("top", F.col("level") * F.col("w")).alias("target"))


def _draw(total: str, marked: str, drawn: str, u: str) -> str:
    """SQL: how many of ``marked`` among ``total`` are in ``drawn`` taken at random, by inversion at ``u``.

    Probabilities relative to the mode follow from their ratios; all values within nine deviations count,
    beyond which the rest is below the precision of ``u``.
    """
    ratio = "(CAST(c.q - k AS double) * (c.d - k)) / (CAST(k + 1 AS double) * (c.r - c.q - c.d + k + 1))"
    low, high = "greatest(0L, c.d - (c.r - c.q))", "least(c.d, c.q)"
    mode = f"least({high}, greatest({low}, CAST(floor((c.d + 1.0D) * (c.q + 1.0D) / (c.r + 2.0D)) AS bigint)))"
    wide = ("CAST(ceil(9 * sqrt(c.d * (c.q / c.r) * (1 - c.q / c.r) * (c.r - c.d) / greatest(c.r - 1.0D, 1.0D))) AS bigint) + 9")
    up = "IF(c.b > c.m, sequence(c.m, c.b - 1), CAST(array() AS array<bigint>))"
    down = "IF(c.m > c.a, sequence(c.m - 1, c.a, -1L), CAST(array() AS array<bigint>))"

    def fold(steps: str, factor: str, start: str, value: str) -> str:
        """Runs through ``steps``: p the probability, s the sum so far, x the value at which the sum passes c.t (null before)."""
        return (f"aggregate({steps}, named_struct('p', 1.0D, 's', {start}, 'x', CAST(NULL AS bigint)), (z, k) -> named_struct("
                f"'p', z.p * {factor}, 's', z.s + z.p * {factor}, "
                f"'x', coalesce(z.x, IF(z.s + z.p * {factor} > c.t, {value}, NULL))))")

    def let(outer: str, fields: str, body: str) -> str:
        return f"element_at(transform(array(named_struct({fields})), {outer} -> {body}), 1)"

    last = let("c", "'r', c.r, 'q', c.q, 'd', c.d, 'm', c.m, 'a', c.a, 'b', c.b, 't', c.u * (c.up + c.down), 'up', c.up",
               "IF(c.t < 1, c.m, IF(c.t < c.up, " + fold(up, ratio, "1.0D", "k + 1") + ".x, coalesce("
               + fold(down, f"(1 / ({ratio}))", "c.up", "k") + ".x, c.m)))")
    sums = let("c", "'r', c.r, 'q', c.q, 'd', c.d, 'm', c.m, 'a', c.a, 'b', c.b, 'u', c.u, "
               "'up', " + fold(up, ratio, "1.0D", "k").replace("> c.t", "IS NULL") + ".s, "
               "'down', " + fold(down, f"(1 / ({ratio}))", "0.0D", "k").replace("> c.t", "IS NULL") + ".s", last)
    edges = let("c", f"'r', c.r, 'q', c.q, 'd', c.d, 'u', c.u, 'm', c.m, 'a', greatest({low}, c.m - c.w), 'b', least({high}, c.m + c.w)", sums)
    centre = let("c", f"'r', c.r, 'q', c.q, 'd', c.d, 'u', c.u, 'm', {mode}, 'w', {wide}", edges)
    plain = let("c", f"'r', {total}, 'q', {marked}, 'd', {drawn}, 'u', {u}",
                f"IF({low} = {high}, {low}, {centre})")
    return plain


def _children(seed: int) -> str:
    """SQL: the two children of a node (lo, hi, start, quota), or the node itself if it is one shard."""
    left_size = "(mid - lo) * total DIV (hi - lo)"
    u = f"((shiftrightunsigned(xxhash64({seed}L, lo, hi, i), 11) + 0.5D) / 9007199254740992.0D)"
    left = (f"aggregate(sequence(0, size(quota) - 1), named_struct('r', total, 'd', {left_size}, 'x', CAST(array() AS array<bigint>)), "
            "(acc, i) -> element_at(transform(array(" + _draw("acc.r", "quota[i]", "acc.d", u) + "), x -> "
            "named_struct('r', acc.r - quota[i], 'd', acc.d - x, 'x', concat(acc.x, array(x)))), 1)).x")
    return left


def split(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(shard, start, quota) leaves from one row (quota: array of blocks of each source).

    ``start`` holds, for each source, the first place of its random order that the shard takes.
    """
    nodes = quotas.select(F.lit(0).cast("bigint").alias("lo"), F.lit(shards).cast("bigint").alias("hi"),
                          F.expr("transform(quota, x -> 0L)").alias("start"), "quota")
    for level in range(max(0, math.ceil(math.log2(shards)))):
        if level and level % 8 == 0:
            nodes = nodes.repartition("lo")
        sized = nodes.withColumns({"mid": F.expr("(lo + hi) DIV 2"), "total": F.expr("aggregate(quota, 0L, (a, x) -> a + x)")})
        halved = sized.withColumn("left", F.expr(f"IF(hi - lo < 2, quota, {_children(seed)})"))
        nodes = halved.select(F.expr("""inline(IF(hi - lo < 2, array(named_struct('lo', lo, 'hi', hi, 'start', start, 'quota', quota)), array(
            named_struct('lo', lo, 'hi', mid, 'start', start, 'quota', left),
            named_struct('lo', mid, 'hi', hi, 'start', zip_with(start, left, (a, b) -> a + b), 'quota', zip_with(quota, left, (a, b) -> a - b)))))"""))
    return nodes.select(F.col("lo").alias("shard"), "start", "quota")


def sized(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """(id, source, size, k1, k2, copy) of every row, written once; ``copy`` numbers rows equal in id, text and source."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(source).cast("string").alias("source"), n_words(text).alias("size"),
                       *row_keys(doc_id, text, source))
    return stored(rows.withColumn("copy", F.row_number().over(W.partitionBy("k1", "k2").orderBy("k1"))), "sizes")


def plan(base: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0,
         block_words: int | None = 256, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(targets, draws) of a mix of ``base``, the rows of ``sized``.

    A draw is one block taken once: k1, k2, copy (the row), block, first_word, words, epoch (0, or 1 when the
    order begins again), shard and place (its order in the shard).  ``block_words`` None takes whole
    documents; otherwise the last block drawn of a source is cut so that its words meet the target to one word.
    Documents without words have no blocks, or as whole documents one of no words.
    """
    goal = stored(targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    cells = max(1, -(-base.count() // CELL))
    rows = base.join(goal, base.source.eqNullSafe(goal.source)).drop("source")
    if block_words:
        rows = rows.filter("size > 0").withColumn(
            "block", F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / block_words).cast("int") - 1)))
        rows = rows.withColumn("first_word", F.col("block").cast("long") * block_words).withColumn(
            "words", F.least(F.lit(block_words).cast("long"), F.col("size") - F.col("first_word")))
    else:
        rows = rows.withColumns({"block": F.lit(0), "first_word": F.lit(0).cast("long"), "words": F.col("size")})
    rows = rows.withColumn("u", uniform("k1", "k2", "copy", "block", seed=seed)).withColumn("cell", F.floor(F.col("u") * cells))
    rows = rows.select("k1", "k2", "copy", "block", "first_word", "words", "u", "i", "cell", "source_size", "target")

    upto = W.partitionBy("i").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy("i", "cell").agg(F.count("*").alias("n"), F.sum("words").alias("w"))
    sums = sums.select("i", "cell", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("n0"), F.coalesce(F.sum("w").over(upto), F.lit(0)).alias("w0"),
                       F.sum("n").over(W.partitionBy("i")).alias("blocks"))
    own = W.partitionBy("i", "cell").orderBy("u", "k1", "k2", "copy", "block")
    placed = rows.withColumns({"n1": F.row_number().over(own) - 1,
                               "w1": F.sum("words").over(own.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("words")})
    placed = placed.join(sums, ["i", "cell"]).withColumns({
        "rank": F.col("n0") + F.col("n1"), "before": F.col("w0") + F.col("w1"),
        "times": F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)})
    rest = F.col("target") - F.col("times") * F.col("source_size")
    if block_words:
        more = F.greatest(F.lit(0), F.least("words", F.round(rest).cast("long") - F.col("before")))
        again = more > 0
    else:
        more, again = F.col("words"), (rest > 0) & (F.col("before") + F.col("words") / 2 <= rest)
    turns = F.sequence(F.lit(0), (F.col("times") + F.when(again, 1).otherwise(0)).cast("int"))  # one too many, for an empty range
    drawn = placed.withColumn("more", more).withColumn("epoch", F.explode(F.slice(turns, 1, F.size(turns) - 1)))
    drawn = stored(drawn.select("k1", "k2", "copy", "block", "first_word", F.when(F.col("epoch") < F.col("times"), F.col("words")).otherwise(F.col("more")).alias("words"),
                                "epoch", "i", (F.col("rank") + F.col("epoch") * F.col("blocks")).alias("at")), "draws")

    per_source = goal.select("i").join(drawn.groupBy("i").agg(F.count("*").alias("q")), "i", "left")
    quotas = per_source.agg(F.expr("transform(array_sort(collect_list(struct(i, coalesce(q, 0L) AS q))), x -> x.q)").alias("quota"))
    shards = max(1, -(-drawn.count() // SHARD))
    leaves = split(quotas, shards, seed).select("shard", F.posexplode(F.arrays_zip("start", "quota")).alias("i", "x"))
    places = leaves.filter("x.quota > 0").select("shard", "i", F.explode(F.expr("sequence(x.start, x.start + x.quota - 1)")).alias("at"))
    # both sides grow with the rows, though the plan takes the leaves of one row for few
    mixed = drawn.join(places.hint("merge"), ["i", "at"])
    order = W.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "k1", "copy", "block", "epoch"), "k2", "epoch")
    return goal, mixed.withColumn("place", F.row_number().over(order)).drop("at")


def summary(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", **settings) -> DataFrame:
    """(doc_id, size, source_size, target, taken, pieces, shards) for every row: the words that the mix takes of it, repeats counted.

    A null text has no words; a null source is a source of its own, the last.  Rows that repeat id, source and text count
    each for itself.  Other columns are not read.
    """
    base = sized(docs, text, doc_id, source)
    goal, draws = plan(base, **settings)
    taken = draws.groupBy("k1", "k2", "copy").agg(F.sum("words").alias("taken"), F.count("*").alias("pieces"),
                                                 F.count_distinct("shard").alias("shards"))
    rows = base.join(taken, ["k1", "k2", "copy"], "left").join(goal, base.source.eqNullSafe(goal.source)).drop("source")
    zero = F.lit(0).cast("long")
    return rows.select(F.col("id").alias(doc_id), "size", "source_size", "target", F.coalesce("taken", zero).alias("taken"),
                       F.coalesce("pieces", zero).alias("pieces"), F.coalesce("shards", zero).alias("shards"))


def mixed_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", **settings) -> DataFrame:
    """The rows of ``docs`` as often as a mix of whole documents draws them, with their own columns; texts travel once."""
    _, draws = plan(sized(docs, text, doc_id, source), block_words=None, **settings)
    times = draws.groupBy(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).agg(F.collect_list("copy").alias("__copies"))
    names = [f"__{i}" for i in range(len(docs.columns))]
    mine = [names[docs.columns.index(c)] for c in (doc_id, text, source)]
    keyed = docs.toDF(*names).withColumns(dict(zip(("__k1", "__k2"), row_keys(*mine), strict=True)))
    numbered = keyed.withColumn("__n", F.row_number().over(W.partitionBy("__k1", "__k2").orderBy("__k1")))
    drawn = numbered.join(times, ["__k1", "__k2"]).withColumn("__e", F.explode(F.expr("filter(__copies, x -> x = __n)")))
    return drawn.select(*names).toDF(*docs.columns)
