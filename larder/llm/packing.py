"""Best-fit packing of documents into token sequences by hierarchical residual packing.

A task tokenizes its documents and packs the pieces by best fit, longest first.  Nearly full sequences are
final.  The others become items of the next round: a tree of ever fewer tasks packs them, whole, by
best fit again, each round passing on what is still underfull.  Between rounds only (sequence, tokens) pairs
move, never texts or tokens; a task gets ``ITEMS`` of them at most, on average, however many there are.
"""

from __future__ import annotations

import base64
import functools
import re
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import give_back, lean, stored

#: Pieces packed at once in the first round; items of a task and fan-in of the tree in later ones.
PIECES, ITEMS, FAN_IN = 50_000, 100_000, 8
_SPACES, _CUT = re.compile(r"\s "), re.compile(r"(?<=\S) ")


class Encoder:
    """Token ids of texts as little-endian 32-bit numbers.

    The tokenizer works on each run of letters, digits or signs by itself and a space belongs to the run
    after it, so a text may be cut before every space that follows something else.  The parts recur and are remembered.
    ``ranks`` and ``pattern`` are the same vocabulary for a second library that is several times faster on a new part; without them, and for parts
    that may hold a special token, the tokenizer itself is asked.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None, most: int = 300_000):
        from tokenizers import Tokenizer

        self.path, self.most, self.quick = path, most, None
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if ranks:
            import tiktoken

            with open(ranks, "rb") as lines:
                known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.quick = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=known, special_tokens={})
            self.tokenizer = None  # loaded again for a part that needs it: few texts do
        self.known = _Known(self)

    def encode(self, part: str) -> bytes:
        if self.quick and not any(s in part for s in self.special):
            ids = self.quick.encode_ordinary(part)
        else:
            if self.tokenizer is None:
                from tokenizers import Tokenizer

                self.tokenizer = Tokenizer.from_file(self.path)
            ids = self.tokenizer.encode(part, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        first, *rest = _CUT.split(text) if _SPACES.search(text) else text.split(" ")
        return self.encode(first) + b"".join(map(self.known.__getitem__, rest))


class _Known(dict):
    """Ids of a space and a part; emptied when full."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, part: str) -> bytes:
        if len(self) >= self.encoder.most:
            self.clear()
        ids = self.encoder.encode(" " + part)
        if len(part) < 64:
            self[part] = ids
        return ids


@functools.lru_cache(maxsize=1)
def _encoder(*files: str) -> Encoder:
    """One for a worker process, which serves task after task."""
    return Encoder(*files)


def best_fit(lengths: list[int], size: int) -> tuple[list[int], list[int], int]:
    """(bin, offset) of each length and the number of bins: longest first, each into the fullest bin that has room."""
    bins, offsets, count = [0] * len(lengths), [0] * len(lengths), 0
    room: list[list[int]] = [[] for _ in range(size + 1)]
    some = 0  # bit f is set if a bin has f tokens free
    for i in sorted(range(len(lengths)), key=lambda j: -lengths[j]):
        n = lengths[i]
        fits = some >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            b = room[free].pop()
            if not room[free]:
                some &= ~(1 << free)
        else:
            free, b, count = size, count, count + 1
        bins[i], offsets[i] = b, size - free
        room[free - n].append(b)
        some |= 1 << (free - n)
    return bins, offsets, count


def _tokenized(docs: DataFrame, files: tuple, size: int, end: int, text: str, doc_id: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, bin, at): every piece, packed by the task that read it."""
    schema = (f"{doc_id} {docs.schema[doc_id].dataType.simpleString()}, piece int, start long, length long, "
              "ids_crc32 long, bin long, at long")
    tail = end.to_bytes(4, "little")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, held, base = _encoder(*files), [], TaskContext.get().partitionId() << 36

        def flush():
            nonlocal base, held
            bins, offsets, count = best_fit([p[3] for p in held], size)
            columns = [*zip(*held, strict=True), [base + b for b in bins], offsets]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
            base, held = base + count, []
            return out
        types = None
        for batch in batches:
            types = types or [batch.schema.types[0], pa.int32(), *[pa.int64()] * 5]
            names = [doc_id, "piece", "start", "length", "ids_crc32", "bin", "at"]
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder(value.as_py()) + tail
                total = len(ids) // 4
                a, piece = 0, 0
                while a < total:
                    b = a + ((total - a) % size or size)
                    held.append((key, piece, a, b - a, zlib.crc32(ids[4 * a:4 * b])))
                    a, piece = b, piece + 1
                if len(held) >= PIECES:
                    yield flush()
        if held:
            yield flush()
        give_back()
    return docs.select(doc_id, text).mapInArrow(pack, schema)


def _round(items: DataFrame, tasks: int, size: int) -> DataFrame:
    """(bin, into, at, used) for every underfull bin, packed whole with others of its task; ``used`` is of the bin it went into."""
    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a fixed order, so that a task that runs again gives the same
        rows = pd.concat([*batches, pd.DataFrame({"bin": [], "used": []})]).astype("int64").sort_values(["used", "bin"], ascending=False)
        bins, offsets, count = best_fit(rows["used"].tolist(), size)
        names = rows["bin"].tolist()
        first: dict[int, int] = {}
        for name, b in zip(names, bins, strict=True):
            first.setdefault(b, name)
        used = [0] * count
        for b, n in zip(bins, rows["used"].tolist(), strict=True):
            used[b] += n
        yield pd.DataFrame({"bin": names, "into": [first[b] for b in bins], "at": offsets, "used": [used[b] for b in bins]})
    spread = items.select("bin", "used").repartition(tasks, F.xxhash64("bin", F.lit(tasks)))
    return spread.mapInPandas(merge, "bin long, into long, at long, used long")


def packed(docs: DataFrame, files: tuple, size: int = 2048, end: int = 0, slack: int = 8, text: str = "text",
           doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document.

    A document is its token ids and ``end``; one longer than ``size`` is cut from the back into full pieces, so the first may be
    shorter.  A null text counts as empty and is one token.  Rows that repeat an id are packed each for itself; a null id stays null.
    ``files`` are the tokenizer file and, if given, the same vocabulary as ranks with its pattern (see ``Encoder``).
    ``slack`` is the free room up to which a sequence counts as full before the last round.
    """
    spark = docs.sparkSession
    lean(spark)
    pieces = stored(_tokenized(docs, files, size, end, text, doc_id), "pieces")
    bins = pieces.groupBy("bin").agg(F.sum("length").alias("used"))
    items = stored(bins.filter(F.col("used") < size - slack), "underfull")
    moved = None
    count = items.count()
    tasks = max(1, spark.sparkContext.defaultParallelism, -(-count // ITEMS))
    while count > 1:
        tasks = max(1, -(-tasks // FAN_IN), -(-count // ITEMS))
        step = stored(_round(items, tasks, size), "merged")
        if moved is None:
            moved = step.select("bin", "into", "at")
        else:
            left, right = moved.alias("a"), step.alias("b")
            moved = stored(left.join(right, F.col("a.into") == F.col("b.bin"), "left").select(
                "a.bin", F.coalesce("b.into", "a.into").alias("into"), (F.col("a.at") + F.coalesce("b.at", F.lit(0))).alias("at")), "moved")
        items = step.filter((F.col("bin") == F.col("into")) & (F.col("used") < size - slack)).select("bin", "used")
        before, count = count, items.count()
        if tasks == 1 or before - count < before // 1000:
            break
    if moved is None:
        return pieces.withColumnsRenamed({"bin": "sequence_id", "at": "offset"})
    moved = moved.select(F.col("bin").alias("from"), "into", F.col("at").alias("shift"))
    joined = pieces.join(moved, pieces["bin"] == moved["from"], "left")
    return joined.select(doc_id, "piece", "start", "length", "ids_crc32", F.coalesce("into", "bin").alias("sequence_id"),
                         (F.col("at") + F.coalesce("shift", F.lit(0))).alias("offset"))
