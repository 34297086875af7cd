"""Whitening of embeddings by their covariance, in two passes over the distinct vectors.

Entries are counted in steps of 1/256, so that sums are integers and exact.  The first pass gives the mean, the
second sums outer products of centred vectors by one matrix product a batch; a tree of merges brings the
partial matrices together, and only one matrix of the vectors' width comes to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.session import Workspace

#: Steps a unit: an entry c becomes floor(STEPS * c).
STEPS = 256
COMPONENTS = 4
_LOW = np.int64((1 << 32) - 1)
_LARGEST = (1 << 63) - 1


@dataclass
class Fit:
    """What the distinct vectors say: their number, sums, and components by falling eigenvalue.

    ``axes`` has one unit eigenvector a column; ``values`` their eigenvalues, 0 where they are no
    more than rounding; ``identity_error`` the largest entry by which the covariance of the
    whitened vectors differs from the identity, NaN without a component of positive eigenvalue.
    """

    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = float("nan")

    @property
    def width(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n: whole numbers are taken away exactly, then what is left of the mean."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([(s - int(w) * self.n) / self.n for s, w in zip(self.sums, whole)])
        if len(x) and max(abs(int(x.min())), abs(int(x.max()))) > 1 << 61:  # their difference may be no 64-bit number
            return x.astype(np.float64) - whole.astype(np.float64) - rest
        return (x - whole).astype(np.float64) - rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Vectors projected on the components, each over the root of its eigenvalue; NaN where that is 0."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return self.centred(x) @ self.axes / np.where(self.values > 0, np.sqrt(self.values), np.nan)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The exact sum over dimensions of (n*x - S)^2; None where it is no 64-bit number."""
        if not len(x):
            return []
        largest = self.n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, self.sums))
        if self.width * largest * largest <= _LARGEST:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(axis=1).tolist()
        exact = [sum((self.n * int(v) - s) ** 2 for v, s in zip(row, self.sums)) for row in x]
        return [d if d <= _LARGEST else None for d in exact]


def in_steps(vector: Column) -> Column:
    """Entries as whole steps; null unless all of them are finite numbers."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return F.when(vector.isNotNull() & finite, F.transform(vector, lambda c: F.floor(c.cast("double") * STEPS).cast("long")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _merged(x: DataFrame, width: int, zero: np.ndarray, step: Callable, merge: Callable):
    """``step`` sums a batch's matrix into an array like ``zero``; ``merge`` brings two tasks' arrays together."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = zero.copy()
        for batch in batches:
            if batch.num_rows:
                total += step(_matrix(batch.column(0), width))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    kind = zero.dtype
    parts = x.mapInArrow(partial, "part binary").rdd

    def add(a, row):
        b = np.frombuffer(bytes(row.part), kind)
        return b if a is None else merge(a, b)

    return parts.treeAggregate(None, add, lambda a, b: b if a is None else a if b is None else merge(a, b), depth=3)


def _halves(x: np.ndarray) -> np.ndarray:
    """Sums of the upper and the lower 32 bits, neither of which a task can overflow, and the number of rows."""
    return np.concatenate([(x >> 32).sum(axis=0), (x & _LOW).sum(axis=0), [len(x)]])


def fit(distinct: DataFrame, width: int, components: int | None = COMPONENTS) -> Fit:
    """The mean and the first ``components`` (None: all) of a written table of distinct vectors ``x`` of one width."""
    whole = lambda a, b: a.astype(object) + b.astype(object)  # noqa: E731  Python's integers do not overflow
    sums = _merged(distinct, width, np.zeros(2 * width + 1, np.int64), _halves, whole)
    n = int(sums[-1]) if sums is not None else 0
    if not n:
        return Fit(0, [0] * width, np.zeros((width, 0)), np.zeros(0), 0.0)
    out = Fit(n, [(int(a) << 32) + int(b) for a, b in zip(sums[:width], sums[width : 2 * width])], np.zeros((width, 0)), np.zeros(0), 0.0)

    def outer(x: np.ndarray) -> np.ndarray:
        y = out.centred(x)
        return (y.T @ y).ravel()

    plus = lambda a, b: a + b
    covariance = _merged(distinct, width, np.zeros(width * width), outer, plus).reshape(width, width) / n
    values, axes = np.linalg.eigh(covariance)
    kept = np.argsort(-values, kind="stable")[: width if components is None else components]
    rounding = width * np.finfo(np.float64).eps * max(values.max(initial=0), 0)
    out.trace = float(np.trace(covariance))
    out.axes, out.values = axes[:, kept], np.where(values[kept] > rounding, values[kept], 0.0)
    real = int((out.values > 0).sum())
    if real:

        def again(x: np.ndarray) -> np.ndarray:
            w = out.whitened(x)[:, :real]
            return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

        found = _merged(distinct, width, np.zeros(real + real * real), again, plus) / n
        mean = found[:real]
        out.identity_error = float(np.abs(found[real:].reshape(real, real) - np.outer(mean, mean) - np.eye(real)).max())
    return out


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int | None = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row a vector and component.

    Vectors that are null or hold null or non-finite entries are left out, and so are those whose
    width is not the most common one (of equally common ones, the larger).  Of repeated
    vectors one counts for the fit; every row gets its result, rows with the same or no key too.
    An entry whose steps are no 64-bit number counts as the nearest one.  ``components`` beyond
    the width are none.  ``deviation`` is null where it exceeds 64 bits, ``whitened`` where the
    component's eigenvalue is 0 to rounding, ``explained`` where all vectors are equal.  Of equal
    eigenvalues any basis may come.  Without vectors, or with empty ones only, the result is empty.
    Columns other than the two are ignored.
    """
    spark = rows.sparkSession
    work = Workspace(spark, "whitening")
    kept = rows.select(F.col(key).alias("key"), in_steps(F.col(vector)).alias("x")).where("x is not null")
    common = kept.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).head()
    width = common.width if common else 0
    kept = kept.where(F.size("x") == width)
    found = fit(work.save(kept.select("x").distinct(), "distinct"), width, components) if width else Fit(0, [], np.zeros((0, 0)), np.zeros(0), 0.0)
    sent = spark.sparkContext.broadcast(found)
    names = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    kinds = [T.IntegerType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType(), T.DoubleType()]
    schema = T.StructType([T.StructField(key, rows.schema[key].dataType), *map(T.StructField, names, kinds)])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = sent.value
        many = f.axes.shape[1]
        explained = [v / f.trace if f.trace > 0 else None for v in f.values.tolist()]
        error = None if np.isnan(f.identity_error) else f.identity_error
        for batch in batches:
            if not batch.num_rows or not many:
                continue
            x = _matrix(batch.column(1), f.width)
            every = np.repeat(np.arange(len(x)), many)
            deviation = pa.array(f.deviations(x), pa.int64())
            columns = [
                batch.column(0).take(pa.array(every)),
                pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(every), f.n)),
                deviation.take(pa.array(every)),
                pa.array(f.whitened(x).ravel(), from_pandas=True),
                pa.array(explained * len(x), pa.float64()),
                pa.array([error] * len(every), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [key, *names])

    return kept.mapInArrow(project, schema)
