"""Whitening of embeddings by a compensated covariance.

Entries become integers, x = floor(SCALE * c) + SHIFT, and each different vector
is fitted once. Sums are exact, so a centred entry x - S/n is an integer minus a
constant of its dimension and is kept as a high and a low double. Outer products
are taken by an error-free transformation: the centred block is cut into slices
of SLICE_BITS-bit integers, the product of two slices is an exact matrix product
in double precision, and the products are added in double-double. Tasks return
the high and the low part, which are merged as such, a row of the matrix a group.
The eigenvectors are LAPACK's, by tridiagonal divide and conquer, followed by one
step of iterative refinement in extended precision.

Scale: different vectors are found by one shuffle with map-side combine, so a
vector that is very often repeated costs a row a task; bytes are laid out by
planes, which Spark's compression makes small. All other passes are scans of
that table in blocks of BLOCK rows and return a matrix a task. Only the
matrix of d x d entries and d sums reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from fractions import Fraction
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, tidy_shuffles

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Rows of a block and bits of a slice: BLOCK * 2 ** (2 * SLICE_BITS) is 2 ** 53, so that a block's products of slices are exact.
BLOCK, SLICE_BITS, SLICES = 2048, 21, 5
#: Entries beyond are held at this.
MOST = 2**61
SCHEMA = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"

Pair = tuple[np.ndarray, np.ndarray]


def two_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    """a + b and its rounding error, exactly."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add(a: Pair, b: Pair) -> Pair:
    """Sum of double-doubles."""
    s, e = two_sum(a[0], b[0])
    return two_sum(s, e + a[1] + b[1])


def whole(c: np.ndarray) -> np.ndarray:
    """Entries as integers."""
    return np.clip(np.floor(SCALE * c.astype(np.float64)), -MOST, MOST).astype(np.int64) + SHIFT


def planes(x: np.ndarray) -> list[bytes]:
    """Each row's bytes, those of a kind together."""
    return [row.tobytes() for row in np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(len(x), -1, 8).transpose(0, 2, 1))]


def unplanes(rows: pa.Array, d: int) -> np.ndarray:
    """planes() of a column, as (rows, d) integers."""
    data = np.frombuffer(b"".join(rows.to_pylist()), np.uint8).reshape(-1, 8, d)
    return np.ascontiguousarray(data.transpose(0, 2, 1)).view("<i8").reshape(-1, d)


def usable(column: pa.ListArray, d: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and their integer vectors, one length at a time, of the vectors without null and non-finite entries."""
    lengths = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    for size in np.unique(lengths[lengths > 0]) if d is None else [d]:
        at = np.flatnonzero(lengths == size)
        values = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), size)
        good = np.isfinite(values).all(1)
        yield at[good], whole(values[good])


class Centre(NamedTuple):
    """The fit list's means as floor + rest / n."""

    n: int
    floor: np.ndarray
    rest: list[int]

    def high_low(self, x: np.ndarray) -> Pair:
        """x - S/n as a double-double."""
        part = [Fraction(r, self.n) for r in self.rest]
        c = np.array([float(p) for p in part])
        c_low = np.array([float(p - Fraction(float(p))) for p in part])
        off = x - self.floor
        near = off.astype(np.float64)
        high, low = two_sum(near, -c)
        return two_sum(high, low + ((off - near.astype(np.int64)) - c_low))

    def deviations(self, x: np.ndarray) -> list[Decimal | None]:
        """Sum over the dimensions of (n x - S)^2, exactly; null beyond 38 digits."""
        off, rest = x - self.floor, self.rest
        if x.size and (self.n * (int(np.abs(off).max()) + 1)) ** 2 * x.shape[1] < 2**63:
            sums = ((off * self.n - np.array(rest, np.int64)) ** 2).sum(1).tolist()
        else:
            sums = [sum((self.n * o - r) ** 2 for o, r in zip(row, rest, strict=True)) for row in off.tolist()]
        return [Decimal(s) if s < 10**38 else None for s in sums]


def slices(v: Pair) -> tuple[list[np.ndarray], np.ndarray]:
    """A block of double-doubles as slices of integers, the highest first, and the columns' exponents: slice s counts 2 ** (exponent - (s + 1) * SLICE_BITS)."""
    rest, low = v
    exponent = np.frexp(np.abs(rest).max(0))[1]
    out = []
    for s in range(SLICES):
        if s == 2:
            rest = rest + low
        out.append(np.rint(np.ldexp(rest, (s + 1) * SLICE_BITS - exponent)))
        rest = rest - np.ldexp(out[-1], exponent - (s + 1) * SLICE_BITS)
    return out, exponent


def outer(v: Pair) -> Pair:
    """Sum of the rows' outer products as a double-double matrix; at most BLOCK rows."""
    cut, exponent = slices(v)
    d = len(exponent)
    total: Pair = (np.zeros((d, d)), np.zeros((d, d)))
    for both in range(SLICES):
        for s in range(both + 1):
            product = np.ldexp(cut[s].T @ cut[both - s], exponent[:, None] + exponent[None, :] - (both + 2) * SLICE_BITS)
            total = add(total, (product, np.zeros((d, d))))
    return total


def summed_outer(fit: DataFrame, d: int, of: Callable[[np.ndarray], Pair], k: int) -> np.ndarray:
    """Sum over the fit list of the outer products of ``of`` its vectors (k entries each), high and low part: (2, k, k)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                more = outer(of(unplanes(b.column(0).slice(at, BLOCK), d)))
                total = more if total is None else add(total, more)
        if total is not None:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array([part] * k, pa.int32()), *(pa.array([r.tobytes() for r in m], pa.binary()) for m in total)], names=["i", "part", "high", "low"])

    def merge(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("part")
        high, low = ([np.frombuffer(r, np.float64) for r in rows.column(c).to_pylist()] for c in ("high", "low"))
        total = reduce(add, zip(high, low, strict=True))
        return pa.table({"i": rows.column("i").slice(0, 1), "high": pa.array([total[0].tobytes()], pa.binary()), "low": pa.array([total[1].tobytes()], pa.binary())})

    parts = fit.select("x").mapInArrow(task, "i int, part int, high binary, low binary")
    rows = parts.groupBy("i").applyInArrow(merge, "i int, high binary, low binary").orderBy("i").collect()
    return np.array([[np.frombuffer(r[c], np.float64) for r in rows] for c in ("high", "low")])


def centre(fit: DataFrame, d: int) -> Centre:
    """Exact means of the fit list; decimals hold the sums."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for b in batches:
            x = unplanes(b.column(0), d)
            n += len(x)
            total = [t + (h << 32) + w for t, h, w in zip(total, (x >> 32).sum(0).tolist(), (x & 0xFFFFFFFF).sum(0).tolist(), strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int32()), pa.array([Decimal(v) for v in (n, *total)], pa.decimal128(38, 0))], names=["i", "v"])

    rows = fit.select("x").mapInArrow(task, "i int, v decimal(38,0)").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    n, *sums = (int(r.v) for r in rows)
    return Centre(n, np.array([s // n for s in sums], np.int64), [s % n for s in sums])


def eigen(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns; their largest entry is positive) of a symmetric double-double matrix."""
    matrix = high.astype(np.longdouble) + low
    matrix = (matrix + matrix.T) / 2
    _, q = np.linalg.eigh(matrix.astype(np.float64))
    x = q.astype(np.longdouble)
    r = np.eye(len(x), dtype=np.longdouble) - x.T @ x
    s = x.T @ matrix @ x
    e = np.diag(s) / (1 - np.diag(r))
    near = 2 * (np.abs(s - np.diag(e)).sum(1).max() + np.abs(e).max() * np.abs(r).sum(1).max())
    gap = e[None, :] - e[:, None]
    far = np.abs(gap) > near
    x = x + x @ np.where(far, (s + e[None, :] * r) / np.where(far, gap, 1), r / 2)
    x /= np.sqrt((x * x).sum(0))
    e = (x * (matrix @ x)).sum(0)
    order = np.argsort(-e, kind="stable")
    x = x[:, order]
    x *= np.sign(x[np.abs(x).argmax(0), range(len(x))])
    return e[order].astype(np.float64), x.astype(np.float64)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vectors(vec_id, embedding) -> vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    Rows are left out whose vector is null, empty, holds null or non-finite
    entries, or is not of the most frequent length (ties: the longer). Each row
    left has a row for each of the first components whose eigenvalue is above
    rounding (2**-48 of the largest): none where all vectors are equal. Rows that
    repeat an id or a vector each have their own; a null id stays null. Entries
    beyond 2**61 / 64 are held there; a deviation over 38 digits is null. Empty
    tables give no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "embedding")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, x in usable(b.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(planes(x), pa.binary())], names=["x"])

    with tidy_shuffles(spark):
        fit = checkpointed(rows.select("embedding").mapInArrow(packed, "x binary").groupBy("x").agg(F.count(F.lit(1)).alias("copies")))
        lengths = fit.groupBy(F.octet_length("x").alias("bytes")).agg(F.sum("copies").alias("rows")).orderBy(F.desc("rows"), F.desc("bytes")).first()
        if lengths is None:
            return spark.createDataFrame([], SCHEMA)
        d = lengths.bytes // 8
        fit = fit.where(F.octet_length("x") == lengths.bytes)
        middle = centre(fit, d)
        n = middle.n
        values, basis = eigen(*(summed_outer(fit, d, middle.high_low, d) / n))
        k = int((values[:components] > max(values[0], 0) * 2.0**-48).sum())
        if not k:
            return spark.createDataFrame([], SCHEMA)
        explained, basis = values[:k] / values.sum(), basis[:, :k] / np.sqrt(values[:k])

        def project(x: np.ndarray) -> np.ndarray:
            return middle.high_low(x)[0] @ basis

        identity = summed_outer(fit, d, lambda x: ((z := project(x)), np.zeros_like(z)), k)
    error = float(np.abs(identity.sum(0) / n - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in usable(b.column(1), d):
                again = pa.array(np.repeat(np.arange(len(at)), k))
                columns = [
                    b.column(0).take(pa.array(at)).take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(len(at) * k, n)),
                    pa.array(middle.deviations(x), pa.decimal128(38, 0)).take(again), pa.array(project(x).ravel()), pa.array(np.tile(explained, len(at))), pa.array(np.full(len(at) * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])

    return rows.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, SCHEMA)
