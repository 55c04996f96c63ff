"""Embedding whitening from a polarisation covariance.

The covariance of two dimensions is half of what the variance of their sum has over their own two
variances. So tasks only add up squares, of every centred dimension and of every sum of two; the
entries are whole numbers, so all of it is exact, and no order of rows or tasks changes a bit of it.
The differences are assembled to one matrix on the driver, of a dimension's size, for ``eigh``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kwloom.llm.base import Sent, stored

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Entries of this magnitude or more have no whole number here; they count as not finite.
LARGEST = 2.0**40
#: Rows whose squares are added up at a time.
ROWS = 4096
_LONG = 2**63


def whole(vector: str | Column, scale: int = SCALE, shift: int = SHIFT) -> Column:
    """floor(scale * entry) + shift of every entry, as long; null if an entry is null or not finite."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    sound = F.forall(
        vector, lambda c: F.coalesce((F.abs(c.cast("double")) < F.lit(LARGEST)) & ~F.isnan(c.cast("double")), F.lit(False))
    )
    return F.when(sound, F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))) + F.lit(shift).cast("long")))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, dims)


def _summed(fit: DataFrame, dims: int, part: Callable[[np.ndarray], np.ndarray]) -> list[int]:
    """The exact column sums of ``part`` over all rows: added up in tasks, then by Spark in decimals."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | int = 0
        for batch in batches:
            x = _matrix(batch.column("x"), dims)
            for begin in range(0, len(x), ROWS):
                total = total + part(x[begin:begin + ROWS]).astype(object)
        if not isinstance(total, int):
            values = [Decimal(int(v)) for v in total]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(values)), pa.int32()), pa.array(values, pa.decimal128(38, 0))], names=["at", "value"]
            )

    rows = fit.select("x").mapInArrow(run, "at int, value decimal(38,0)")
    summed = rows.groupBy("at").agg(F.sum("value").alias("value")).collect()  # a row for each pair of dimensions
    return [int(r.value) for r in sorted(summed)]


def _added(squares: np.ndarray) -> np.ndarray:
    return squares.sum(axis=1)


def squares(centred: np.ndarray) -> np.ndarray:
    """Exact sums of y_i**2 for every i, then of (y_i + y_j)**2 for all i < j, over the rows."""
    y = np.ascontiguousarray(centred.T)
    most = 2 * int(np.abs(y).max(initial=0))
    if most * most * max(y.shape[1], 1) >= _LONG:
        y = y.astype(object)  # whole numbers of any size
    own = _added(y * y)
    pairs = [_added(np.square(y[i + 1:] + y[i])) for i in range(len(y) - 1)]
    return np.concatenate([own, *pairs])


@dataclass
class Whitening:
    """What is learned from the fit list: its size, sums, and the components with their eigenvalues."""

    n: int
    sums: list[int]
    centre: np.ndarray
    rest: np.ndarray
    vectors: np.ndarray
    scales: np.ndarray
    explained: np.ndarray

    @classmethod
    def assemble(cls, n: int, sums: list[int], centre: list[int], squared: list[int], components: int) -> Whitening:
        """From the sums and the exact squares round the whole numbers ``centre``, in Python's whole numbers.

        With y = x - c and T its sum, the sum of (n*x - S)**2 is n*n * sum(y**2) - n * T**2; the
        same holds for sums of two dimensions.
        """
        dims = len(sums)
        rest = [s - n * c for s, c in zip(sums, centre, strict=True)]
        around = lambda total, t: n * n * total - n * t * t
        own = [around(squared[i], rest[i]) for i in range(dims)]
        covariance = np.zeros((dims, dims))
        at = dims
        for i in range(dims):
            covariance[i, i] = own[i] / n**3
            for j in range(i + 1, dims):
                both = around(squared[at], rest[i] + rest[j])
                covariance[i, j] = covariance[j, i] = (both - own[i] - own[j]) / (2 * n**3)
                at += 1
        values, vectors = np.linalg.eigh(covariance)
        values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
        trace = sum(own) / n**3
        sound = values > dims * np.finfo(float).eps * max(trace, 0.0)
        scales = np.full(len(values), np.nan)
        scales[sound] = 1 / np.sqrt(values[sound])
        explained = np.maximum(values, 0) / trace if trace > 0 else np.full(len(values), np.nan)
        return cls(n, sums, np.array(centre, dtype=np.int64), np.array([t / n for t in rest]), vectors, scales, explained)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """The rows of ``x`` on every component; NaN on one without variance."""
        return ((x - self.centre) - self.rest) @ self.vectors * self.scales

    def deviation(self, x: np.ndarray) -> list[int]:
        """The exact sum of (n*x - S)**2 of each row."""
        y, t = x - self.centre, np.array([s - self.n * int(c) for s, c in zip(self.sums, self.centre, strict=True)], dtype=object)
        most = self.n * (int(np.abs(y).max(initial=0)) + 1)  # a rest is at most half of n
        if most * most * max(x.shape[1], 1) >= _LONG:
            return (np.square(y.astype(object) * self.n - t)).sum(axis=1).tolist()
        return np.square(y * self.n - t.astype(np.int64)).sum(axis=1).tolist()


def fit(vectors: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening:
    """Learned from each distinct row of ``vectors`` (x) once, all of ``dims`` entries."""
    n = vectors.count()
    sums = _summed(vectors, dims, lambda x: x.sum(axis=0))
    centre = [(2 * s + n) // (2 * n) for s in sums]  # the whole number nearest to the mean
    around = np.array(centre, dtype=np.int64)
    squared = _summed(vectors, dims, lambda x: squares(x - around))
    return Whitening.assemble(n, sums, centre, squared, components)


def identity_error(vectors: DataFrame, dims: int, learned: Whitening) -> float | None:
    """Largest entry of the whitened rows' covariance minus the identity, over components with variance."""
    size, sent = len(learned.scales), Sent(vectors.sparkSession, learned)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, total = sent.value, np.zeros((size + 1, size))
        for batch in batches:
            w = np.nan_to_num(model.whitened(_matrix(batch.column("x"), dims)))
            total[:size] += w.T @ w
            total[size] += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], names=["at", "value"])

    rows = vectors.select("x").mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    total = np.array([r.value for r in sorted(rows)]).reshape(size + 1, size) / learned.n
    sound = ~np.isnan(learned.scales)
    covariance = total[:size] - np.outer(total[size], total[size])  # the rows are centred; this takes off what rounding left
    off = np.abs(covariance - np.eye(size))[np.ix_(sound, sound)]
    return float(off.max()) if off.size else None


def whiten(
    df: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id",
    components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT,
) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component.

    Entries become whole numbers x = floor(scale * entry) + shift. Each distinct x-vector counts
    once in what is learned. Dropped are null and empty vectors, vectors with null, non-finite or
    enormous entries (2**40 or more), and vectors of another length than most have (a tie: than
    the shorter). Repeated rows and rows with a null id are projected like any other. A component
    without variance (n = 1, all vectors the same, or fewer vectors than components) has a null
    ``whitened``; ``explained`` is null where nothing varies at all; ``identity_error`` covers
    the components with variance. A ``deviation`` beyond a long is null. An empty table gives no
    rows. Other columns are not read.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), whole(vector_col, scale, shift).alias("x")).where("size(x) > 0")
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    lengths = rows.groupBy(F.size("x").alias("dims")).agg(F.count(F.lit(1)).alias("n"))
    most = lengths.orderBy(F.desc("n"), "dims").first()
    if most is None:
        return df.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    dims = most.dims
    rows = rows.where(F.size("x") == dims)
    distinct = stored(rows.select("x").distinct())
    learned = fit(distinct, dims, components)
    error = identity_error(distinct, dims, learned)
    sent = Sent(df.sparkSession, learned)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        size = len(model.scales)
        number = np.arange(1, size + 1, dtype=np.int32)
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                part = batch.slice(begin, ROWS)
                x = _matrix(part.column("x"), dims)
                each = np.repeat(np.arange(len(x)), size)
                deviation = pa.array([v if v < _LONG else None for v in model.deviation(x)], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id").take(pa.array(each)), pa.array(np.tile(number, len(x))),
                        pa.array(np.full(len(each), model.n)), deviation.take(pa.array(each)),
                        pa.array(model.whitened(x).ravel(), from_pandas=True),
                        pa.array(np.tile(model.explained, len(x)), from_pandas=True),
                        pa.array([error] * len(each), pa.float64()),
                    ],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
