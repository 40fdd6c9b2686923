"""Whitening of vectors by a covariance of two passes.

Components become integers x = floor(UNIT * c) + SHIFT, so that the first pass,
sums per dimension, is exact whatever the order of the rows. The second pass
centres the rows by these sums and adds up their outer products, a matrix
product a batch; treeAggregate merges both. LAPACK's symmetric eigenvalues of
that one matrix give the projection, which is broadcast: its size depends on
the dimensions alone. A third pass over the projected rows measures how far
their covariance is from the identity.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlake.llm.common import table

UNIT, SHIFT, COMPONENTS = 1024.0, 100_000, 8
#: Rows centred and multiplied at once.
SLICE = 8192
_LONG = float(2**63)


@dataclass
class Whitener:
    """n vectors with the sums of their integers; vectors holds a component a column, values their variances, falling."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def project(self, x: np.ndarray) -> np.ndarray:
        """Rows of integers on the components, each with variance 1."""
        return centred(x, self.n, self.sums) @ self.vectors / np.sqrt(self.values)


def usable(vector: str, dim: int | None = None) -> F.Column:
    """A vector without null and non-finite entries, of the given number of them (at least one)."""
    v = F.col(vector)
    ok = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(ok & (F.size(v) > 0 if dim is None else F.size(v) == dim), F.lit(False))


def integers(column: pa.Array) -> np.ndarray:
    """x of each vector; one beyond a long's range is the nearest long."""
    flat = column.flatten()
    c = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    scaled = np.floor(UNIT * c)
    x = np.where(np.abs(scaled) < _LONG / 2, scaled, 0.0).astype(np.int64) + SHIFT
    x = np.where(scaled >= _LONG / 2, np.iinfo(np.int64).max, np.where(scaled <= -_LONG / 2, np.iinfo(np.int64).min, x))
    return x.reshape(len(column), -1)


def exact_sums(x: np.ndarray) -> list[int]:
    """Sums per dimension, in Python's integers where a long might not hold them."""
    if len(x) and float(np.abs(x.astype(np.float64)).max()) * len(x) >= _LONG / 2:
        x = x.astype(object)
    return [int(s) for s in x.sum(axis=0)]


def multiples(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: longs, or Python's integers where these might not hold them."""
    largest = max(float(np.abs(x.astype(np.float64)).max(initial=0.0)) * n, float(max(map(abs, sums), default=0)))
    if largest >= _LONG / 4:
        return x.astype(object) * n - np.array(sums, object)
    return x * n - np.array(sums, np.int64)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return (multiples(x, n, sums) / n).astype(np.float64)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over the dimensions of (n * x - S)^2, exact; None where a long can't hold it."""
    m = multiples(x, n, sums)
    if len(m) and m.shape[1] * float(np.abs(m.astype(np.float64)).max()) ** 2 >= _LONG / 2:
        return [s if s < 2**63 else None for s in (sum(int(v) ** 2 for v in row) for row in m)]
    return (m * m).sum(axis=1).tolist()


def tree_sum(vectors: DataFrame, vector: str, of_batch: Callable[[np.ndarray], np.ndarray | list], zero: np.ndarray | list) -> np.ndarray | list:
    """The sum of of_batch over the rows: one row a task in Spark, and those merged level by level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                got = of_batch(integers(batch.column(0).slice(at, SLICE)))
                total = got if total is None else plus(total, got)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total, 5)], pa.binary())], names=["part"])

    def plus(a: np.ndarray | list, b: np.ndarray | list) -> np.ndarray | list:
        return [i + j for i, j in zip(a, b, strict=True)] if isinstance(a, list) else a + b

    parts = vectors.select(vector).mapInArrow(run, "part binary").rdd
    depth = 2 if parts.getNumPartitions() <= 1024 else 3
    return parts.treeAggregate(zero, lambda a, row: plus(a, pickle.loads(row["part"])), plus, depth)


def fit(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> tuple[int | None, Whitener | None]:
    """(dimensions, model) of the usable vectors of the most frequent length (the longer of equals); (None, None) for no such row.

    Components whose variance is nothing but rounding are left out.
    """
    lengths = vectors.filter(usable(vector)).groupBy(F.size(vector).alias("dim")).agg(F.count("*").alias("n"))
    found = lengths.orderBy(F.desc("n"), F.desc("dim")).first()
    if found is None:
        return None, None
    dim, n = found["dim"], found["n"]
    rows = vectors.filter(usable(vector, dim))
    sums = tree_sum(rows, vector, exact_sums, [0] * dim)

    def outer(x: np.ndarray) -> np.ndarray:
        z = centred(x, n, sums)
        return z.T @ z

    covariance = tree_sum(rows, vector, outer, np.zeros((dim, dim))) / n
    values, parts = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > max(values.max(), 0.0) * dim * np.finfo(float).eps * 4]
    parts = parts[:, order]
    signs = np.sign(parts[np.abs(parts).argmax(axis=0), np.arange(parts.shape[1])])
    return dim, Whitener(n, sums, values[order], parts * signs, float(np.trace(covariance)))


def identity_error(rows: DataFrame, vector: str, model: Whitener) -> float:
    """The largest entry of the projected rows' covariance minus the identity, measured on these rows."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    k = len(model.values)

    def moments(x: np.ndarray) -> np.ndarray:
        w = np.column_stack([shared.value.project(x), np.ones(len(x))])
        return w.T @ w

    got = tree_sum(rows, vector, moments, np.zeros((k + 1, k + 1))) / model.n
    mean = got[-1, :-1]
    return float(np.abs(got[:-1, :-1] - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """key, component (from 1), n, deviation, whitened, explained and identity_error of each usable row and component.

    Rows whose vector is null, empty, of another length than most, or holds null or non-finite entries are left out;
    null keys stay; repeated rows count and come out each. Where fewer components have variance (equal rows, few
    rows) only these come out; an empty table gives no rows. A deviation beyond a long is null.
    """
    fields = [(key, vectors.schema[key].dataType), ("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType())]
    schema = T.StructType([T.StructField(*f) for f in [*fields, *((c, T.DoubleType()) for c in ("whitened", "explained", "identity_error"))]])
    dim, model = fit(vectors, vector, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = vectors.select(key, vector).filter(usable(vector, dim))
    error = identity_error(rows, vector, model)
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k = len(m.values)
        for batch in batches:
            for at in range(0, len(batch) if k else 0, SLICE):
                part = batch.slice(at, SLICE)
                x, each = integers(part.column(1)), pa.array(np.repeat(np.arange(len(part)), k))
                columns = [
                    part.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1), len(part)), pa.int32()), pa.array(np.full(len(part) * k, m.n), pa.int64()),
                    pc.take(pa.array(deviations(x, m.n, m.sums), pa.int64()), each), pa.array(m.project(x).ravel()),
                    pa.array(np.tile(m.values / m.trace, len(part))), pa.array(np.full(len(part) * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    return rows.mapInArrow(run, schema)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable row of embeddings on the 8 components of largest variance."""
    return whiten(table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"))
