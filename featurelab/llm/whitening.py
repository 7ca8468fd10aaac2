"""Whitening of embeddings on their leading principal components.

Vectors become integer codes, whose sums are exact; every product is of codes less their mean. A randomised range finder
with oversampling goes over all rows in repeated power passes. Rayleigh-Ritz in its range gives components and, from the
same pass, their residuals: how far the covariance moves a component off its own line. If a wanted one's is still too
large after the last pass, the range is widened to all dimensions, where one more pass is exact. Each task sums its rows'
products into one matrix, and tasks' matrices are summed by tasks too; the driver gets one.

Defined cases: vectors that are null, empty, of another length than most (ties: the shorter), or that hold null or
non-finite components or such with codes of 2^53 or more take no part; a row without an id is a row, and repeated rows
count each; with fewer dimensions than ``components`` there are fewer; a component without variance (less than 1e-13 of the
largest) is whitened to 0, explains 0 and is left out of identity_error; a deviation beyond a long is null; an empty table
gives an empty result; further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Tasks that sum the matrices of all tasks, before one sums theirs.
GROUPS = 16
RESULT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def codes(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, x): x holds floor(64 c) + 1,000,000 of each component c, in double precision."""
    some = rows.filter(F.size(vector) > 0)
    dims = some.groupBy(F.size(vector).alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim = dims[0].dim if dims else 0

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = np.floor(64.0 * batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)) + 1_000_000  # null is NaN
            fits = (np.abs(c) < 2.0**53).all(axis=1)
            x = c[fits].astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * dim), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(fits)), lists], names=["vec_id", "x"])

    alike = some.filter(F.size(vector) == dim).select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("c"))
    return alike.mapInArrow(coded, "vec_id bigint, x array<bigint>")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)


def summed(rows: DataFrame, of_batch: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | None:
    """The sum of ``of_batch`` (code matrix to an array of one shape and type) over all batches; None without rows."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = of_batch(_matrix(batch))
                total = own if total is None else total + own
        yield from told(total)

    def told(total: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        if total is not None:
            columns = [pa.array([TaskContext.get().partitionId() % GROUPS], pa.int32()), pa.array([list(total.shape)], pa.list_(pa.int32())), pa.array([total.dtype.str]), pa.array([total.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "shape", "kind", "data"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for shape, kind, data in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                own = np.frombuffer(data, dtype=kind).reshape(shape)
                total = own if total is None else total + own
        yield from told(total)

    schema = "part int, shape array<int>, kind string, data binary"
    one = rows.mapInArrow(partial, schema).repartition(GROUPS, "part").mapInArrow(together, schema).repartition(1).mapInArrow(together, schema)
    got = one.collect()  # one row
    return np.frombuffer(bytes(got[0].data), dtype=got[0].kind).reshape(got[0].shape) if got else None


class Moments:
    """Number of rows and exact sums; ``centred`` takes the mean from codes without losing digits."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self._floor = np.array([s // n for s in sums], dtype=np.int64)
        self._rest = np.array([s % n for s in sums], dtype=np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self._floor).astype(np.float64) - self._rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Of each row the sum of (n x - S)^2, exact; None beyond a long."""
        d = x - self._floor
        if d.size and (float(np.abs(d).max()) + 1) ** 2 * self.n**2 * x.shape[1] < 2.0**62:
            return ((self.n * d - self._rest) ** 2).sum(axis=1).tolist()
        exact = ((self.n * d.astype(object) - self._rest.astype(object)) ** 2).sum(axis=1)
        return [v if v < 1 << 63 else None for v in exact]


def moments(rows: DataFrame) -> Moments | None:
    """Of codes. Halves are summed apart, so that sums of up to 2^36 rows stay exact."""
    halves = summed(rows, lambda x: np.vstack([np.full(x.shape[1], len(x)), (x >> 26).sum(axis=0), (x & ((1 << 26) - 1)).sum(axis=0)]))
    return None if halves is None else Moments(int(halves[0, 0]), [(int(a) << 26) + int(b) for a, b in zip(halves[1], halves[2])])


def principal_components(rows: DataFrame, about: Moments, components: int, oversample: int = 10, passes: int = 3, tolerance: float = 1e-13, seed: int = 11) -> tuple[np.ndarray, np.ndarray, float, int]:
    """(eigenvalues, unit eigenvectors as columns, trace, passes over the rows) of the codes' covariance."""
    dim, random = len(about.sums), np.random.default_rng(seed)
    k = min(components, dim)
    basis = np.linalg.qr(random.standard_normal((dim, min(dim, k + oversample))))[0]
    for done in range(1, passes + 2):

        def products(x: np.ndarray, q: np.ndarray = basis) -> np.ndarray:
            c = about.centred(x)
            return np.column_stack([c.T @ (c @ q), (c * c).sum(axis=0)])

        got = summed(rows, products) / about.n
        moved, trace = got[:, :-1], float(got[:, -1].sum())
        inside = basis.T @ moved
        e, w = np.linalg.eigh((inside + inside.T) / 2)
        e, w = e[::-1], w[:, ::-1]
        found = basis @ w
        residual = np.linalg.norm((moved @ w - found * e)[:, :k], axis=0)
        if basis.shape[1] == dim or residual.max() <= tolerance * max(e[0], 0):
            break
        if done < passes:
            basis = np.linalg.qr(moved)[0]
        else:
            basis = np.linalg.qr(np.column_stack([found, random.standard_normal((dim, dim - found.shape[1]))]))[0]
    found = found[:, :k] / np.linalg.norm(found[:, :k], axis=0)
    return np.maximum(e[:k], 0), found, trace, done


def whitened(rows: DataFrame, components: int = 32, vector: str = "embedding") -> DataFrame:
    """Columns of RESULT for every vector and component."""
    spark = rows.sparkSession
    coded = materialize(codes(rows, vector), "codes")
    about = moments(coded)
    if about is None:
        return spark.createDataFrame([], RESULT)
    e, axes, trace, _ = principal_components(coded, about, components)
    real = e > 1e-13 * max(e[0], 0)
    scaled = np.where(real, axes / np.sqrt(np.where(real, e, 1)), 0.0)

    def products(x: np.ndarray) -> np.ndarray:
        w = np.column_stack([about.centred(x) @ scaled[:, real], np.ones(len(x))])
        return w.T @ w

    got = summed(coded, products) / about.n
    mean = got[-1, :-1]
    off = np.abs(got[:-1, :-1] - np.outer(mean, mean) - np.eye(int(real.sum())))
    error = float(off.max()) if off.size else 0.0

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch)
                w = about.centred(x) @ scaled
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(about.deviations(x), pa.int64()), lists], names=["vec_id", "deviation", "w"])

    shares = [float(x) / trace if trace > 0 and r else 0.0 for x, r in zip(e, real)]
    wide = coded.mapInArrow(project, "vec_id bigint, deviation bigint, w array<double>")
    long = wide.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return long.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(about.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(F.array(*map(F.lit, shares)), F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
