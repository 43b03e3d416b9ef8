"""Embedding whitening from a compensated covariance.

Components become integers x = floor(256 * component).  The fit list, each distinct vector once, is
written to the shared folder; its size n and sums S are exact integers.  The mean S/n is held in
double-double (a high part and what it lacks), so centring loses nothing that matters.

The covariance sums the outer products of the centred rows in double-double.  A batch's centred values
are cut into three slices of so few bits, on a grid common to the batch, that a matrix product of two
slices is exact in doubles: an error-free transformation of the batch's outer products, as a handful
of matrix products.  Those that can reach the sum's 63 leading bits join it by the error-free
two-sum, high and low parts apart.  Each task hands on one pair of matrices; the tasks' pairs are
merged the same way, ``FAN`` at a time, so no task gets more than ``FAN`` of them from the one before.

The covariance, dimension x dimension and no larger with more rows, goes to the driver once.  Its
eigen-solve is LAPACK's divide and conquer (``numpy.linalg.eigh`` is ``syevd``): Householder reduction
to a tridiagonal matrix, which is torn in two again and again and mended by the secular equation.  All
rows are projected with these vectors, so a sign is the same for all of them.  A second pass over the
fit list sums the outer products of the whitened rows the same way, which gives ``identity_error``.

Defined results: rows with a null vector or a null or non-finite entry are dropped; a null id stays
null; repeated rows and ids each give their own rows; an empty table, and vectors without entries, give
none.  A component whose variance is no more than rounding (below dimension * 2^-52 of the largest
eigenvalue) has no direction and isn't returned, so constant vectors give no rows.  ``deviation`` is null
where it exceeds a long.  Vectors of different lengths raise ValueError.  Integers beyond 2^53 in
magnitude raise ArithmeticError.  Columns of other names are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_schema, materialize, releasing, small_batches

ROWS = 1024  # rows whose outer products are summed before they join the sum
BITS = 21  # of a slice: the product of two has 42, the sum over ROWS rows at most 52
FAN = 64
COLUMNS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def integers(rows: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, x of the rows that take part."""
    whole = F.transform("embedding", lambda c: c.cast("double"))
    finite = F.forall(whole, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)
    return rows.select("vec_id", F.transform(whole, lambda c: F.floor(c * scale).cast("long")).alias("x"))


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rounded sum and its exact error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def dd_add(high: np.ndarray, low: np.ndarray, more: np.ndarray, rest: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """The double-double (high, low) and (more, rest) together."""
    s, e = two_sum(high, more)
    return two_sum(s, e + (low + rest))


def slices(high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
    """Three parts of ``high + low`` of ``BITS`` bits each, on grids that all values share; what is left is below
    2^-62 of the largest value."""
    top = float(np.abs(high).max(initial=0.0))
    if top == 0.0:
        return []
    unit = 2.0 ** (np.frexp(top)[1] - BITS + 1)
    parts = []
    for _ in range(3):
        part = np.rint(high / unit) * unit
        parts.append(part)
        high, low = two_sum(high - part, low)  # the difference is exact
        unit *= 2.0**-BITS
    return parts


def outer_sums(high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
    """Matrices, each exact, that sum up to the outer products of at most ``ROWS`` rows ``high + low``; smallest first."""
    parts = slices(high, low)
    found = [parts[i].T @ parts[j] for i in range(len(parts)) for j in range(len(parts)) if i + j <= 2]
    return sorted(found, key=lambda m: float(np.abs(m).max(initial=0.0)))


@dataclass
class Sum:
    """A matrix in double-double."""

    high: np.ndarray
    low: np.ndarray

    @staticmethod
    def zero(n: int) -> Sum:
        return Sum(np.zeros((n, n)), np.zeros((n, n)))

    def add(self, high: np.ndarray, low: np.ndarray | float = 0.0) -> None:
        self.high, self.low = dd_add(self.high, self.low, high, low)

    def add_rows(self, high: np.ndarray, low: np.ndarray) -> None:
        for at in range(0, len(high), ROWS):
            for part in outer_sums(high[at : at + ROWS], low[at : at + ROWS]):
                self.add(part)

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, m.size], pa.int32()), pa.array(m.ravel())) for m in (self.high, self.low)], names=["high", "low"])

    @staticmethod
    def of(parts: pa.Table | pa.RecordBatch, row: int) -> Sum:
        values = [np.asarray(parts[c][row].values) for c in ("high", "low")]
        return Sum(*(v.reshape(round(len(v) ** 0.5), -1) for v in values))


PARTS = "high array<double>, low array<double>"


def merged_sum(parts: DataFrame, tasks: int) -> Sum | None:
    """The parts of all tasks as one, merged ``FAN`` at a time; None if there are none."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for part in (Sum.of(batch, row) for row in range(batch.num_rows)):
                if total is None:
                    total = part
                else:
                    total.add(part.high, part.low)
        if total is not None:
            yield total.batch()

    while tasks > 1:
        tasks = -(-tasks // FAN)
        parts = parts.repartition(tasks).mapInArrow(merge, PARTS)
    found = parts.toArrow()  # one matrix
    return Sum.of(found, 0) if found.num_rows else None


def matrix(batch: pa.RecordBatch, column: str = "x") -> np.ndarray:
    """The batch's vectors as integers, row by row."""
    lengths = np.unique(np.asarray(batch[column].value_lengths()))
    if len(lengths) > 1:
        raise ValueError(f"vectors of different lengths: {lengths.tolist()}")
    x = np.asarray(batch[column].flatten(), np.int64).reshape(batch.num_rows, -1)
    if x.size and max(int(x.max()), -int(x.min())) >= 1 << 53:
        raise ArithmeticError("a component beyond 2^53")
    return x


@dataclass(frozen=True)
class Mean:
    """n and S of the fit list, and S/n in double-double."""

    n: int
    sums: tuple[int, ...]

    @cached_property
    def parts(self) -> tuple[np.ndarray, np.ndarray]:
        exact = [Fraction(s, self.n) for s in self.sums]
        high = [float(e) for e in exact]
        return np.array(high), np.array([float(e - Fraction(h)) for e, h in zip(exact, high, strict=True)])

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        high, low = self.parts
        s, e = two_sum(x.astype(np.float64), -high)
        return two_sum(s, e - low)


def mean_of(fit: DataFrame) -> Mean | None:
    """Exact: each task sums the halves of its integers apart, and sums meet by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, upper, lower = 0, None, None
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch)
                if upper is not None and len(upper) != x.shape[1]:
                    raise ValueError(f"vectors of different lengths: {sorted({len(upper), x.shape[1]})}")
                upper = (x >> 26).sum(0) + (0 if upper is None else upper)
                lower = (x & ((1 << 26) - 1)).sum(0) + (0 if lower is None else lower)
                n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), *(pa.array([v.tolist()], pa.list_(pa.int64())) for v in (upper, lower))], names=["n", "upper", "lower"])

    parts = fit.select("x").mapInArrow(releasing(run), "n long, upper array<long>, lower array<long>")
    each = parts.select("n", F.size("upper").alias("size"), F.posexplode(F.arrays_zip("upper", "lower")).alias("dim", "v"))
    totals = each.groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("v.upper").cast("decimal(38,0)")).alias("u"), F.sum(F.col("v.lower").cast("decimal(38,0)")).alias("l"), F.min("size").alias("a"), F.max("size").alias("b"))
    found = sorted(totals.collect())  # a row a dimension
    if not found:
        return None
    if any(r["a"] != r["b"] for r in found):
        raise ValueError(f"vectors of different lengths: {sorted({x for r in found for x in (r['a'], r['b'])})}")
    return Mean(found[0]["n"], tuple((int(r["u"]) << 26) + int(r["l"]) for r in found))


def covariance_sum(fit: DataFrame, rows_of: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], tasks: int) -> Sum | None:
    """The sum of the outer products of ``rows_of`` (integers to a high and a low part) over the fit list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                high, low = rows_of(matrix(batch))
                total = total or Sum.zero(high.shape[1])
                total.add_rows(high, low)
        if total is not None:
            yield total.batch()

    return merged_sum(fit.select("x").mapInArrow(releasing(run), PARTS), tasks)


def eigen(total: Sum, n: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues by falling size, unit vectors (columns), and shares of the trace of the first ``most`` components with any variance."""
    v = (total.high + total.low) / n
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    held = min(most, int(np.count_nonzero(values > len(values) * 2.0**-52 * max(values[0], 0.0))))
    return values[:held], vectors[:, :held], values[:held] / np.trace(v)


def deviations(x: np.ndarray, mean: Mean) -> list[int | None]:
    """Sum over dimensions of (n*x - S)^2; None beyond a long."""
    largest = mean.n * (int(np.abs(x).max(initial=0)) + 1) + max(map(abs, mean.sums))
    if largest < 1 << 62 and largest * largest * x.shape[1] < 1 << 63:
        return ((mean.n * x - np.array(mean.sums, np.int64)) ** 2).sum(1).tolist()
    exact = ((mean.n * x.astype(object) - np.array(mean.sums, object)) ** 2).sum(1)
    return [v if v < 1 << 63 else None for v in exact.tolist()]


def whiten(embeddings: DataFrame, components: int = 4, scale: int = 256) -> DataFrame:
    """A row for each vector and each of the first ``components`` components."""
    spark = embeddings.sparkSession
    small_batches(spark)
    rows = integers(embeddings, scale)
    fit = materialize(rows.select("x").distinct(), "whitening-fit")
    mean = mean_of(fit)
    if mean is None:
        return spark.createDataFrame([], COLUMNS)
    tasks = fit.rdd.getNumPartitions()
    values, vectors, explained = eigen(covariance_sum(fit, mean.centred, tasks), mean.n, components)
    if not len(values):
        return spark.createDataFrame([], COLUMNS)
    scaled = vectors / np.sqrt(values)

    def whitened(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        high, low = mean.centred(x)
        out = high @ scaled + low @ scaled
        return out, np.zeros_like(out)

    square = covariance_sum(fit, whitened, tasks)
    error = float(np.abs((square.high + square.low) / mean.n - np.eye(len(values))).max())
    schema, k = arrow_schema(COLUMNS), len(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch)
            of = pa.array(np.repeat(np.arange(len(x)), k))
            columns = [
                batch["vec_id"].take(of), np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)), np.full(k * len(x), mean.n),
                pa.array(deviations(x, mean), pa.int64()).take(of), whitened(x)[0].ravel(), np.tile(explained, len(x)), np.full(k * len(x), error),
            ]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return rows.mapInArrow(releasing(run), COLUMNS)
