"""Substring dedup by relative Lempel-Ziv parsing of documents against an index of all documents.

A *window* is so many consecutive words of one document.  Removed are the words in windows whose
sequence also starts somewhere else, in this or another document.

**Index.**  Every document is a reference, cut into blocks.  In each window the eight-word
sequence with the least hash is its anchor, so equal windows have the same anchor at the same
place.  Consecutive windows with one anchor form a *piece*, on average over a
dozen windows.  Only pieces whose anchor occurs twice or more go on; of most text nothing does.
The index holds each distinct piece with its count and its first place (document, start).

**Parse.**  A document takes its pieces in order.  A piece that the index holds twice or more
is covered whole, and pieces that continue in the same reference join into one factor, as long as it goes.

**Factor boundaries.**  A piece that the index holds once, though its anchor occurs elsewhere,
lies where a factor begins or ends: some of its windows may repeat and others not.
Those windows, and the windows of the pieces with the same anchor, are
looked up one by one (128-bit hashes).  So each window is decided, inside factors and at their ends,
and the result does not depend on which reference came first.

Hot passages cost one row for a piece, combined before each exchange; no two occurrences
are ever paired.  Texts cross the network once: both uses read the same exchange.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import give_back, lean, stored, words

ANCHOR = 8
#: Words that one call of the parser holds; longer documents are parsed in blocks of so many words.
BLOCK = 1 << 18
_M = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


class _Hashes(dict):
    """Word to 64-bit hash; a memory of the words seen, emptied when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


class _Powers:
    """Powers of an odd number and of its inverse, modulo 2**64."""

    def __init__(self, m: int):
        self.m, self.inverse, self.up, self.down = m, pow(m, -1, 1 << 64), np.ones(1, np.uint64), np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (np.cumprod(np.r_[1, np.full(size - 1, x, np.uint64)].astype(np.uint64), dtype=np.uint64)
                                  for x in (np.uint64(self.m), np.uint64(self.inverse)))
        return self.up[:n], self.down[:n]


class Sequences:
    """Hashes of word sequences in a run of words, each a difference of running sums."""

    powers = [_Powers(m) for m in _M]

    def __init__(self, values: np.ndarray):
        self.sums, self.down = [], []
        for p, v in zip(self.powers, (values, _mixed(values ^ np.uint64(_M[1]))), strict=True):
            up, down = p.to(len(values) + 1)
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(v * up[:-1], dtype=np.uint64)]))
            self.down.append(down)

    def hash(self, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
        return _mixed((self.sums[which][end] - self.sums[which][start]) * self.down[which][start])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _runs(texts: list, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Whole documents, several at a time, as (row, place in its document, word value) of each word.

    A long document comes in blocks that overlap by a window less one word.
    """
    hashes, rows, places, values, held = _Hashes(), [], [], [], 0
    for row, text in enumerate(texts):
        tokens = words(text.encode()) if text else []
        for a in range(0, max(1, len(tokens) - window + 1), BLOCK):
            piece = tokens[a:a + BLOCK + window - 1]
            if len(piece) < window:
                continue
            rows.append(np.full(len(piece), row))
            places.append(np.arange(a, a + len(piece)))
            values.append(np.fromiter(map(hashes.__getitem__, piece), np.uint64, len(piece)))
            held += len(piece)
            if held >= BLOCK:
                yield np.concatenate(rows), np.concatenate(places), np.concatenate(values)
                rows, places, values, held = [], [], [], 0
    if held:
        yield np.concatenate(rows), np.concatenate(places), np.concatenate(values)


def _whole(row: np.ndarray, place: np.ndarray, window: int) -> np.ndarray:
    """Whether a window that starts at each word ends in the same block of the same document."""
    last = window - 1
    return (row[last:] == row[:len(row) - last]) & (place[last:] == place[:len(row) - last] + last)


def pieces(keys: np.ndarray, texts: list, window: int) -> Iterator[pa.RecordBatch]:
    """(h, sig, k, s, n): anchor hash, piece hash, document, first window's start, number of windows."""
    for row, place, value in _runs(texts, window):
        sequences = Sequences(value)
        ends = np.arange(ANCHOR, len(value) + 1)
        grams = sequences.hash(ends - ANCHOR, ends)
        width = window - ANCHOR + 1
        anchor = np.lib.stride_tricks.sliding_window_view(grams, width).argmin(1) + np.arange(len(value) - window + 1)
        start = np.nonzero(_whole(row, place, window))[0]
        anchor = anchor[start]
        new = np.r_[True, (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)]
        first = start[new]
        count = np.diff(np.r_[np.nonzero(new)[0], len(start)])
        sig = sequences.hash(first, first + count + window - 1, 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(grams[anchor[new]].view(np.int64)), pa.array(sig.view(np.int64)), pa.array(keys[row[first]]),
             pa.array(place[first].astype(np.int32)), pa.array(count.astype(np.int32))], ["h", "sig", "k", "s", "n"])


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """``docs`` with ``__k``: the id if it is a whole number, never null and never repeats, else a hash of id and text."""
    plain = docs.schema[doc_id].dataType.typeName() in ("byte", "short", "integer", "long")
    if plain:
        total, distinct = docs.agg(F.count("*"), F.count_distinct(doc_id)).first()
        plain = total == distinct
    return docs.withColumn("__k", F.col(doc_id).cast("long") if plain else F.xxhash64(F.col(doc_id), F.col(text)))


def factored(docs: DataFrame, window: int = 35, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with ``__cut``, a struct of ``factors``, ``n_words``, ``n_removed`` and ``kept``.

    Factors are the spans of words that repeat, in order: (start, length, ref, ref_start), the last two the key
    (the id, or where ids are null or repeat a hash of id and text) and place of the first occurrence; a first
    occurrence refers to itself.  A factor is a window long at least.  ``kept`` is the words outside factors, joined by one space.
    Null and empty texts have no words.  Rows that repeat id and text repeat each other's words.
    """
    spark = docs.sparkSession
    lean(spark)
    docs = _keyed(docs, text, doc_id)
    narrow = docs.select("__k", F.col(text).alias("__t"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from pieces(batch["__k"].to_numpy(zero_copy_only=False), batch["__t"].to_pylist(), window)
        give_back()

    every = narrow.mapInArrow(parse, "h long, sig long, k long, s int, n int")
    often = every.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select("h")
    found = stored(every.join(often, "h", "left_semi"), "pieces")
    index = found.groupBy("h", "sig").agg(F.count("*").alias("c"), F.min(F.struct("k", "s")).alias("ref"))
    kinds = index.groupBy("h").agg(F.count("*").alias("kinds"))
    known = index.join(kinds, "h").withColumn("open", F.expr("kinds > 1"))
    marked = stored(found.join(known, ["h", "sig"]).select(
        "k", "s", "n", "c", "ref", (F.col("open") & ((F.col("c") == 1) | (F.col("ref") == F.struct("k", "s")))).alias("open")), "marked")

    # the same exchange of all columns serves the boundary check and the caller
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = docs.repartition(parts, "__k")
    names = spread.columns
    at_k, at_t = names.index("__k"), names.index(text)
    opened = marked.filter("open").groupBy(F.col("k").alias("__k")).agg(F.collect_set(F.struct("s", "n", "c")).alias("__open"))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _windows(batch.column(at_k).to_numpy(zero_copy_only=False), batch.column(at_t).to_pylist(),
                                batch.column(len(names)).to_pylist(), window)
        give_back()

    # a left join, as an inner one would filter the exchange and so need one of its own
    checked = spread.join(opened, "__k", "left").select(*[f"`{c}`" for c in names], "__open").mapInArrow(
        look_up, "k long, s int, w1 long, w2 long, c long")
    twice = checked.groupBy("w1", "w2").agg(F.sum("c").alias("t"), F.min(F.struct("k", "s")).alias("ref")).filter("t > 1")
    loose = checked.filter("c = 1").join(twice, ["w1", "w2"]).select("k", "s", F.lit(1).alias("n"), "ref")
    covers = marked.filter("c > 1").select("k", "s", "n", "ref").unionByName(loose)
    lists = covers.groupBy(F.col("k").alias("__k")).agg(
        F.array_sort(F.collect_set(F.struct("s", "n", F.col("ref.k").alias("rk"), F.col("ref.s").alias("rs")))).alias("__c"))
    joined = spread.join(lists, "__k", "left")
    return joined.select(*[F.col(f"`{c}`") for c in names], _cut(text, window).alias("__cut"))


def _windows(keys: np.ndarray, texts: list, spans: list, window: int) -> Iterator[pa.RecordBatch]:
    """(k, s, w1, w2, c): each window of the listed pieces by its hashes, with the count of its piece."""
    hashes, out, held = _Hashes(), [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["k", "s", "w1", "w2", "c"])
    for key, text, listed in zip(keys, texts, spans, strict=True):
        if not listed:
            continue
        tokens = words(text.encode())
        for a in range(0, len(tokens), BLOCK):
            mine = [x for x in listed if a <= x["s"] < a + BLOCK]
            if not mine:
                continue
            piece = tokens[a:a + BLOCK + 2 * window]
            sequences = Sequences(np.fromiter(map(hashes.__getitem__, piece), np.uint64, len(piece)))
            start = np.concatenate([np.arange(x["s"], x["s"] + x["n"]) for x in mine]) - a
            count = np.concatenate([np.full(x["n"], x["c"], np.int64) for x in mine])
            out.append((np.full(len(start), key, np.int64), (start + a).astype(np.int32),
                        sequences.hash(start, start + window, 0).view(np.int64),
                        sequences.hash(start, start + window, 1).view(np.int64), count))
            held += len(start)
            if held > 100_000:
                yield batch()
                out, held = [], 0
    if out:
        yield batch()


def _factors(covers, window: int) -> list[dict]:
    """Greedy factors from covers in order of place: a cover that continues in the factor's reference lengthens it."""
    done: list[dict] = []
    for x in covers if covers is not None else ():
        end = x["s"] + x["n"] + window - 1
        last = done[-1] if done else None
        if (last and last["ref"] == x["rk"] and last["ref_start"] - last["start"] == x["rs"] - x["s"]
                and x["s"] <= last["start"] + last["length"] - window + 1):
            last["length"] = max(last["length"], end - last["start"])
        else:
            done.append({"start": x["s"], "length": end - x["s"], "ref": x["rk"], "ref_start": x["rs"]})
    return done


_CUT = ("factors array<struct<start: int, length: int, ref: bigint, ref_start: int>>, "
        "n_words bigint, n_removed bigint, kept string")


def _cut(text: str, window: int):
    """(factors, n_words, n_removed, kept) of a row from its text and its covers ``__c``."""
    @F.pandas_udf(_CUT)
    def cut(texts: pd.Series, covers: pd.Series) -> pd.DataFrame:
        rows = []
        for t, listed in zip(texts, covers, strict=True):
            tokens = words(t.encode()) if t else []
            factors, edge = _factors(listed, window), np.zeros(len(tokens) + 1, np.int64)
            for f in factors:
                edge[f["start"]] += 1
                edge[f["start"] + f["length"]] -= 1
            gone = (np.cumsum(edge)[:-1] > 0).tolist()
            left = [w for w, g in zip(tokens, gone, strict=True) if not g] if factors else tokens
            rows.append((factors, len(tokens), len(tokens) - len(left), b" ".join(left).decode()))
        return pd.DataFrame(rows, columns=["factors", "n_words", "n_removed", "kept"])
    return cut(F.col(text), F.col("__c"))


def digest(docs: DataFrame, window: int = 35, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, factors) for every row."""
    cut = factored(docs.select(doc_id, text), window, text, doc_id)
    return cut.select(doc_id, "__cut.n_words", "__cut.n_removed", F.sha2("__cut.kept", 256).alias("kept_sha256"), "__cut.factors")


def without_repeats(docs: DataFrame, window: int = 35, text: str = "text", doc_id: str = "doc_id",
                    n_chars: str = "n_chars") -> DataFrame:
    """``docs`` with repeated words cut from the text and its length, if there is such a column, renewed.

    A text that loses nothing stays as it is; one that loses words is its other words joined by one space.
    Every row stays, with an empty text if all its words repeat.
    """
    cut, changed = factored(docs, window, text, doc_id), F.col("__cut.n_removed") > 0
    out = {text: F.when(changed, F.col("__cut.kept")).otherwise(F.col(text))}
    if n_chars in docs.columns:
        length = F.char_length("__cut.kept").cast(docs.schema[n_chars].dataType)
        out[n_chars] = F.when(changed, length).otherwise(F.col(n_chars))
    return cut.select(*[out.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
