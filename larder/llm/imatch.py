"""I-Match document fingerprints over randomised lexicon subsets.

Terms are the distinct words of a text, lower case.  The lexicon keeps those whose inverse document frequency lies in a
band: met in some document, but not in so many that they say nothing (words that an edit cuts in two are in none).  It is divided at random into ``SUBSETS``
subsets, thinned further for texts of many distinct terms in the band (a term of low random rank survives in larger ones), so that
a text of any length keeps about ``RETAIN`` terms, or all if it has fewer.  A subset's signature is a hash of the text's sorted distinct terms in it.  The likeness of two
texts is the share of equal signatures among those that either has: one changed term changes one subset, not all.

All steps are DataFrame operations.  The neighbour of a document comes from a window over ranges of ids, each with the first
row of the next range as a guest, so texts cross the network once.  Terms above the band are few and sent to all tasks, so that
words are sampled in the row by their number in the band; of each document only the sampled ones travel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from larder.llm.common import row_keys, stored

SUBSETS, RETAIN = 64, 32
#: Band of document frequencies: at least so many documents, at most this share of them.
LEAST_DOCS, MOST_SHARE = 1, 0.1
#: Rows of a range of ids, on average, while there are no more than ``MOST_RANGES`` (and as many of null ids): their cuts and
#: first rows are sent to all tasks, some 50 bytes each.
RANGE, MOST_RANGES = 4096, 65_536
_BLANK = r"[\x20\x09-\x0D]+"


def _terms(text: Column) -> Column:
    """Hashes of the words of a text, repeats included."""
    return F.transform(F.filter(F.split(F.lower(text), _BLANK), lambda w: w != ""), lambda w: F.xxhash64(w))


def _rank(h: Column) -> Column:
    """Random rank of a term, of 53 bits."""
    return F.shiftrightunsigned(h, 11)


def _least(terms: Column) -> Column:
    """The term of least rank in an array, empty for an empty one."""
    return F.array_compact(F.array(F.array_min(F.transform(terms, lambda h: F.struct(_rank(h).alias("r"), h.alias("h"))))["h"]))


def _thinned(terms: Column, n: Column) -> Column:
    """Those of ``terms`` that a text of ``n`` distinct terms in the band keeps; the one of least rank if none would stay.

    Subset b of a text takes terms whose random rank is below 2 ** -floor(x + b / SUBSETS), x the binary logarithm of ``n`` over
    RETAIN: thinning grows by steps with the number, for a few subsets at a time.
    """
    x = F.greatest(F.lit(0.0), F.log2(F.greatest(F.lit(1), n) / F.lit(float(RETAIN))))
    whole = F.floor(x)
    first = F.pow(F.lit(2.0), 53 - whole).cast("long")
    settings = F.struct(first.alias("few"), F.ceil(SUBSETS * (1 - (x - whole))).alias("cut"))
    keep = F.transform(F.array(settings), lambda s: F.filter(terms, lambda h: _rank(h) < F.when(
        h.bitwiseAND(SUBSETS - 1) >= s["cut"], F.shiftright(s["few"], 1)).otherwise(s["few"])))
    return F.element_at(F.transform(keep, lambda k: F.when(F.size(k) > 0, k).otherwise(_least(terms))), 1)


def counts(docs: DataFrame, text: str) -> DataFrame:
    """(h, df): every term with the number of documents that have it."""
    each = docs.select(F.explode(F.array_distinct(_terms(F.col(text)))).alias("h"))
    return each.groupBy("h").agg(F.count("*").alias("df"))


def _among(cuts: list[int], holds) -> Column:
    """How many of the sorted ``cuts`` satisfy ``holds``, which is true up to some cut: a look at the first of each group, then at one group."""
    size = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[a:a + size] for a in range(0, len(cuts), size)]
    before = F.size(F.filter(F.lit([g[0] for g in groups]), holds))  # groups that begin where it holds
    inside = F.transform(F.array(before), lambda g: F.size(F.filter(F.element_at(F.lit(groups), F.greatest(g, F.lit(1))), holds)))[0]
    return F.when(before == 0, F.lit(0)).otherwise((before - 1) * size + inside)


def _range(rows: DataFrame) -> Column:
    """Number of a row's range in the order (id, k1), null ids first: ranges lie between quantiles of the ids, so they hold alike many rows.

    An id that holds several quantiles, and null ids, are divided by ``k1``; only rows equal in id and text stay together.
    """
    total, nulls = rows.agg(F.count("*"), F.count_if(F.col("id").isNull())).first()
    wanted, of_null = (min(MOST_RANGES, max(1, -(-n // RANGE))) for n in (total - nulls, nulls))
    share = F.col("k1") / F.lit(float(2 ** 64)) + 0.5

    def piece(count: Column) -> Column:
        return F.least(F.floor(share * count), count - 1)
    cuts = []
    if wanted > 1:
        at = [i / wanted for i in range(1, wanted)]
        cuts = sorted(rows.agg(F.percentile_approx("id", at, 4 * wanted)).first()[0] or [])
    known = F.lit(0)
    if cuts:
        below, upto = _among(cuts, lambda c: c < F.col("id")), _among(cuts, lambda c: c <= F.col("id"))
        own = upto - below
        known = below + F.least(own, F.lit(1)) + piece(F.greatest(own, F.lit(1)))
    return F.when(F.col("id").isNull(), piece(F.lit(of_null)) - of_null).otherwise(known).cast("long")


def with_next(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(id, t, pos, next_t, next_pos): each document with the next by id (null first, ties by content), the first after the last.

    ``pos`` is a number of the row.  Ids are whole numbers of any size (``ValueError`` for other types), null or repeated.
    """
    if not isinstance(docs.schema[doc_id].dataType, IntegralType):
        raise ValueError(f"{doc_id} must hold whole numbers")
    keys = row_keys(doc_id, text)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"), *keys)
    rows = rows.withColumn("part", _range(rows))
    order = ["id", "k1", "k2"]  # ascending with null first
    least = F.struct(F.col("id").isNotNull().alias("a"), F.coalesce("id", F.lit(0)).alias("b"), "k1", "k2")
    firsts = rows.groupBy("part").agg(F.min(least).alias("x"))
    by_part = W.orderBy("part")  # a row for each range
    firsts = firsts.withColumn("to", F.coalesce(F.lag("part").over(by_part), F.max("part").over(
        by_part.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))).select(
            F.col("part").alias("p"), F.col("x.k1").alias("f1"), F.col("x.k2").alias("f2"), "to")
    firsts = F.broadcast(firsts)  # at most 2 * MOST_RANGES rows, so that no text moves for it
    guests = rows.join(firsts, (rows.part == firsts.p) & (rows.k1 == firsts.f1) & (rows.k2 == firsts.f2)).dropDuplicates(["p"])
    both = rows.select(*order, "t", "part", F.lit(0).alias("guest"), F.lit(0).cast("long").alias("own")).unionByName(
        guests.select(*order, "t", F.col("to").alias("part"), F.lit(1).alias("guest"), F.col("p").alias("own")))
    w = W.partitionBy("part").orderBy("guest", *order)
    number = F.when(F.col("guest") == 1, F.shiftleft("own", 32) + 1).otherwise(F.shiftleft("part", 32) + F.row_number().over(w))
    numbered = both.withColumn("pos", number)
    return numbered.select("id", "t", "pos", "guest", F.lead("t").over(w).alias("next_t"), F.lead("pos").over(w).alias("next_pos")).filter("guest = 0").drop("guest")


def _signatures(terms: Column, fallback: Column) -> Column:
    """For each subset 1 to 65,535 by its sorted terms, 0 without; a text without any gets ``fallback`` in the first."""
    signed = F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), lambda b: F.transform(
        F.array(F.filter(terms, lambda h: h.bitwiseAND(SUBSETS - 1) == b)),
        lambda own: F.when(F.size(own) == 0, 0).otherwise(F.pmod(F.xxhash64(own), F.lit(65_535)) + 1).cast("int"))[0])
    alone = F.concat(F.array(fallback), F.array_repeat(F.lit(0), SUBSETS - 1))
    return F.when(F.size(terms) == 0, alone).otherwise(signed)


def _likeness(a: Column, b: Column) -> Column:
    """Share of equal signatures among those that either text has."""
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    same = F.size(F.filter(pairs, lambda x: (x["a"] == x["b"]) & (x["a"] != 0)))
    either = F.size(F.filter(pairs, lambda x: (x["a"] != 0) | (x["b"] != 0)))
    return F.when(either == 0, F.lit(1.0)).otherwise(same.cast("double") / either)


def _text(signatures: Column) -> Column:
    return F.lower(F.array_join(F.transform(signatures, lambda s: F.lpad(F.hex(s), 4, "0")), ""))


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    The edited text has its last half of code points (rounded down) replaced by as many of the next document's first, or all it has.
    A fingerprint is four hexadecimal digits for each subset; the likeness is of 0 to 1, and 1 for equal texts.  A null text
    counts as empty; a text without terms in the band has a hash of the whole text instead.  Ids are whole numbers
    (``ValueError`` for other types) and may be null or repeat; the next
    document of the last is the first, of a single one itself.
    """
    total = docs.count()
    n = F.char_length("t")
    joined = with_next(docs, text, doc_id).withColumn("e", F.concat(
        F.left("t", n - F.floor(n / 2).cast("int")), F.left("next_t", F.floor(n / 2).cast("int"))))

    def whole(column: str) -> Column:
        return (F.pmod(F.xxhash64(column), F.lit(65_535)) + 1).cast("int")
    known = stored(counts(docs, text), "terms")
    most = max(2, int(MOST_SHARE * total))
    # few terms are above the band: at most the mean number of terms of a document over MOST_SHARE
    common = known.filter(F.col("df") > most).agg(F.collect_list("h").alias("common"))
    info = F.struct("id", n.cast("long").alias("n"), F.sha2("e", 256).alias("sha"), whole("t").alias("ft"), whole("e").alias("fe"), "next_pos").alias("info")
    terms = joined.select("pos", info, F.array_distinct(_terms(F.col("t"))).alias("t"), F.array_distinct(_terms(F.col("e"))).alias("e"),
                          _terms(F.col("next_t")).alias("o")).crossJoin(F.broadcast(common))
    # what the edit cut in two is in neither text: two terms at most, which alone need a look at the others
    parted = terms.select("pos", "info", F.array_except("t", "common").alias("t"), F.array_except("e", "common").alias("e"),
                          F.array_except(F.array_except("e", "t"), "o").alias("unsure"))
    sure = parted.select("pos", "info", "t", F.array_except("e", "unsure").alias("e"), "unsure")
    # written once: it is read twice below, and each reading would send the texts over the network again
    rows = stored(sure.select("pos", "info", _thinned(F.col("t"), F.size("t")).alias("a"), F.size("e").alias("n_e"),
                              F.array_union(_thinned(F.col("e"), F.size("e")), _least(F.col("e"))).alias("b"), "unsure"), "sampled")
    band = known.filter((F.col("df") >= LEAST_DOCS) & (F.col("df") <= most)).select("h")
    found = rows.select("pos", F.explode("unsure").alias("h")).join(band.hint("merge"), "h", "left_semi").groupBy("pos").agg(
        F.collect_list("h").alias("found"))
    both = rows.join(found.hint("merge"), "pos", "left").withColumn("found", F.coalesce("found", F.array().cast("array<bigint>")))
    grouped = both.select("pos", "info", F.array_sort("a").alias("a"), F.array_sort(
        _thinned(F.array_union("b", "found"), F.col("n_e") + F.size("found"))).alias("b"))
    signed = stored(grouped.select("pos", "info.*", _signatures(F.col("a"), F.col("info.ft")).alias("s"),
                                   _signatures(F.col("b"), F.col("info.fe")).alias("s_e")), "signatures")
    following = signed.select(F.col("pos").alias("p"), F.col("s").alias("s_n"))
    result = signed.join(following, signed.next_pos == following.p)
    return result.select(F.col("id").alias(doc_id), F.col("n").alias("n_chars"), F.col("sha").alias("edited_sha256"),
                         _text(F.col("s")).alias("fingerprint"), _text(F.col("s_e")).alias("edited_fingerprint"),
                         _likeness(F.col("s"), F.col("s_e")).alias("near_edited"), _likeness(F.col("s"), F.col("s_n")).alias("near_next"))
