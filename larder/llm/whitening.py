"""Whitening of vectors by a bit-sliced scatter matrix.

Every entry c becomes the whole number x = floor(64 * c) + 1000000.  A block of rows shifts each dimension by its least x there and
writes the shifted numbers as bit planes: one plane holds a bit of one dimension for all rows of the block, 64 rows a word.  The cross-product
of two dimensions is the sum over pairs of planes of 2 ** (a + b) times the set bits of their AND, so no number is rounded.  Blocks give the
exact sums of x and of its products back, tasks add them, and Spark adds those of the tasks in limbs of 32 bits, so that the sums
stay exact for any number of rows.  The covariance is centred in whole numbers, n * sum(x y) - sum(x) * sum(y), and only then
divided; its eigenvectors are those of one small matrix.

The driver sees d * (d + 1) / 2 sums for vectors of d entries, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import lean

SCALE, SHIFT = 64.0, 1_000_000
COMPONENTS = 32
#: x is read as a long of at most so many bits; larger entries count as the largest.
_WIDEST = 2.0 ** 62
_LIMBS, _LIMB = 6, 32


def entries(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold a vector of ``length`` finite entries, and their numbers x."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    whole = np.flatnonzero(sizes == length)
    values = column.take(pa.array(whole)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(whole), length)
    finite = np.isfinite(values).all(axis=1)  # a null is not a number here
    x = np.clip(np.floor(values[finite] * SCALE) + SHIFT, -_WIDEST, _WIDEST).astype(np.int64)
    return whole[finite], x


def planes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit planes of whole numbers of 0 and more (rows x dimensions): words (planes x words), and each plane's dimension and bit."""
    rows, dims = y.shape
    of, bits, words = [], [], []
    for j in range(dims):
        for b in range(int(y[:, j].max()).bit_length() if rows else 0):
            of.append(j)
            bits.append(b)
            packed = np.packbits(((y[:, j] >> b) & 1).astype(np.uint8), bitorder="little")
            words.append(np.pad(packed, (0, -len(packed) % 8)).view(np.uint64))
    n_words = -(-rows // 64)
    return np.array(words, dtype=np.uint64).reshape(len(words), n_words), np.array(of, dtype=np.int64), np.array(bits, dtype=np.int64)


def scatter(x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, sums and cross-products of whole numbers (rows x dimensions), exact, as Python integers."""
    rows, dims = x.shape
    least = x.min(axis=0) if rows else np.zeros(dims, dtype=np.int64)
    # a shift of up to 63 bits fits an unsigned word
    words, of, bits = planes((x.astype(np.uint64) - least.astype(np.uint64)))
    weight = [1 << int(b) for b in bits]
    sums = np.zeros(dims, dtype=object)
    cross = np.zeros((dims, dims), dtype=object)
    ones = np.bitwise_count(words).sum(axis=1, dtype=np.int64)
    starts = np.flatnonzero(np.diff(of, prepend=-1))
    held = of[starts] if len(of) else of
    narrow = len(bits) == 0 or 2 * int(bits.max()) + 2 + rows.bit_length() < 62
    kind = np.int64 if narrow else object
    w = np.array(weight, dtype=kind)
    if len(of):
        sums[held] = np.add.reduceat(ones.astype(kind) * w, starts)
        for p in range(len(of)):
            both = np.bitwise_count(words[p] & words).sum(axis=1, dtype=np.int64)
            cross[of[p], held] += np.add.reduceat(both.astype(kind) * w, starts) * weight[p]
    m = least.astype(object)
    full = cross + np.outer(m, sums) + np.outer(sums, m) + rows * np.outer(m, m)
    return rows, sums + rows * m, full


def _limbs(value: int) -> list[int]:
    """A whole number in limbs of 32 bits, lowest first; the last has the sign."""
    out = []
    for _ in range(_LIMBS - 1):
        out.append(value & ((1 << _LIMB) - 1))
        value >>= _LIMB
    return [*out, value]


def _sums(vectors: DataFrame, length: int) -> dict[tuple[int, int], int]:
    """Exact sums by (i, j), i <= j: products of dimensions; (-1, j): sums of one; (-1, -1): rows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, cross = 0, np.zeros(length, dtype=object), np.zeros((length, length), dtype=object)
        for batch in batches:
            _, x = entries(batch.column(0), length)
            if len(x):
                rows, s, c = scatter(x)
                n, sums, cross = n + rows, sums + s, cross + c
        if n:
            table = [(-1, -1, n), *((-1, j, sums[j]) for j in range(length)),
                     *((i, j, cross[i, j]) for i in range(length) for j in range(i, length))]
            limbs = np.array([_limbs(int(v)) for _, _, v in table], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([t[0] for t in table], pa.int32()), pa.array([t[1] for t in table], pa.int32()), *map(pa.array, limbs.T)],
                names=["i", "j", *[f"l{k}" for k in range(_LIMBS)]])

    limbs = [f"l{k}" for k in range(_LIMBS)]
    parts = vectors.mapInArrow(task, "i int, j int, " + ", ".join(f"{c} long" for c in limbs))
    found = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in limbs]).collect()
    return {(r.i, r.j): sum(r[c] << (_LIMB * k) for k, c in enumerate(limbs)) for r in found}


@dataclass
class Whitening:
    """A fitted transform: whole numbers, and the leading components of their covariance."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # a column for each of them

    @property
    def length(self) -> int:
        return len(self.sums)

    def projected(self, x: np.ndarray) -> np.ndarray:
        """Whitened components of rows of whole numbers."""
        return self._centred(x) / self.n @ (self.vectors / np.sqrt(self.values))

    def _centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact while below 2 ** 53 and the nearest number beyond."""
        sums = np.array(self.sums, dtype=object)
        if self._fits(x):
            return (x * np.int64(self.n) - sums.astype(np.int64)).astype(np.float64)
        return (x.astype(object) * self.n - sums).astype(np.float64)

    def _fits(self, x: np.ndarray) -> bool:
        """True if n * x, S and their squares summed over dimensions stay within a long."""
        if not len(x):
            return True
        sums = self.sums
        far = max(max(abs(int(a) * self.n - s), abs(int(b) * self.n - s)) for a, b, s in zip(x.min(axis=0), x.max(axis=0), sums, strict=True))
        largest = max(max(abs(int(x.min())), abs(int(x.max()))) * self.n, *(abs(s) for s in sums))
        return largest < 2 ** 62 and far * far * self.length < 2 ** 62

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sum over dimensions of (n * x - S) ** 2 for each row, null beyond a long."""
        if self._fits(x):
            return pa.array(((x * np.int64(self.n) - np.array(self.sums, dtype=np.int64)) ** 2).sum(axis=1), pa.int64())
        exact = ((x.astype(object) * self.n - np.array(self.sums, dtype=object)) ** 2).sum(axis=1)
        return pa.array([v if v < 2 ** 63 else None for v in exact], pa.int64())

    @property
    def explained(self) -> np.ndarray:
        """Share of the covariance's trace of each component."""
        return self.values / np.trace(self.covariance)


def usual_length(vectors: DataFrame) -> int:
    """The number of entries that most vectors have, the larger of two; 0 without any."""
    column = F.col(vectors.columns[0])
    row = vectors.filter(F.size(column) > 0).groupBy(F.size(column).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return row["n"] if row else 0


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Means and leading components of all whole, finite vectors; None without any.

    Components whose eigenvalue is zero, up to rounding, are left out: nothing varies along them.
    """
    lean(df.sparkSession)
    vectors = df.select(F.col(vector).alias("v"))
    length = usual_length(vectors)
    sums = _sums(vectors, length) if length else {}
    if not sums:
        return None
    n, s = sums[-1, -1], [sums[-1, j] for j in range(length)]
    covariance = np.array([[(n * sums[min(i, j), max(i, j)] - s[i] * s[j]) / (n * n) for j in range(length)] for i in range(length)])
    values, vectors_ = np.linalg.eigh(covariance)
    values, vectors_ = values[::-1], vectors_[:, ::-1]
    keep = min(components, int((values > max(values[0], 0) * length * 1e-13).sum()) if values[0] > 0 else 0)
    return Whitening(n, s, covariance, values[:keep], vectors_[:, :keep])


def identity_error(df: DataFrame, fitted: Whitening, vector: str = "embedding") -> float:
    """Largest absolute entry of the whitened vectors' covariance, over all rows, minus the identity."""
    k, length = len(fitted.values), fitted.length

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k + 1, k))
        for batch in batches:
            z = fitted.projected(entries(batch.column(0), length)[1])
            sums += np.vstack([z.sum(axis=0), z.T @ z])
        i, j = np.divmod(np.arange((k + 1) * k), k)
        yield pa.RecordBatch.from_arrays([pa.array(i - 1, pa.int32()), pa.array(j, pa.int32()), pa.array(sums.ravel())], names=["i", "j", "s"])

    if not k:
        return 0.0
    parts = df.select(vector).mapInArrow(task, "i int, j int, s double")
    total = np.zeros((k + 1, k))
    for r in parts.groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        total[r.i + 1, r.j] = r.s / fitted.n
    # projected() has taken the mean away before multiplying; what rounding left of it is taken here
    return float(np.abs(total[1:] - np.outer(total[0], total[0]) - np.eye(k)).max())


def whitened(df: DataFrame, fitted: Whitening | None, error: float, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for every whole, finite vector and component."""
    source = df.select(F.col(vec_id).alias("id"), F.col(vector).alias("v"))
    kind = source.schema["id"].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if fitted is None or not len(fitted.values):
        return source.sparkSession.createDataFrame([], schema).withColumnRenamed("id", vec_id)
    k, length, shares = len(fitted.values), fitted.length, fitted.explained

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = entries(batch.column(1), length)
            m = len(rows)
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(rows)).take(each), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                pa.array(np.full(m * k, fitted.n), pa.int64()), fitted.deviations(x).take(each), pa.array(fitted.projected(x).ravel()),
                pa.array(np.tile(shares, m)), pa.array(np.full(m * k, error))],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return source.mapInArrow(task, schema).withColumnRenamed("id", vec_id)


def components(df: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", most: int = COMPONENTS) -> DataFrame:
    """Fits all vectors and whitens them.

    A vector that is null, empty, of another length than most, or holds null or non-finite entries takes no part.  Ids may be null or
    repeat: every row counts.  Without vectors, or where all are equal, there are no components and no rows.  An entry beyond
    2 ** 62 counts as that; a deviation beyond a long is null.  Other columns are not read.
    """
    fitted = fit(df, vector, most)
    return whitened(df, fitted, identity_error(df, fitted, vector) if fitted else 0.0, vector, vec_id)
