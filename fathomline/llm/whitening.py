"""Whitening of embeddings by a randomised range finder.

Entries become integers, so counts, sums and the squared deviations are exact. A random basis of more columns than
components wanted goes through repeated power passes: each multiplies it by the covariance, as a sum over all centred
rows. Every pass also gives the Rayleigh-Ritz components of the basis and their residuals; when these are within
``TOLERANCE`` of the largest eigenvalue the passes end, and when they have not come there after ``PASSES``, the basis is
filled up to all dimensions, where Rayleigh-Ritz is exact. A last pass over the rows measures the variance of each
component and the covariance of the whitened rows.

Per pass a task sends one matrix of (dimensions x basis); these are added in two levels, so the driver gets ``GROUPS``
matrices at most, whatever the number of rows or tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import written

SCALE, SHIFT = 64, 1_000_000
OVERSAMPLING, PASSES, TOLERANCE = 10, 6, 1e-12
#: Matrices that reach the driver, and numbers of a batch of rows in a task.
GROUPS, BATCH_NUMBERS = 32, 1 << 20
#: Entries from here on have no integer of 53 bits and count as not finite.
LARGEST = float(1 << 46)
ROWS = "vec_id bigint, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Model:
    """What whitens a vector: exact sums, components as columns with their eigenvalues, the trace, the largest error."""

    n: int
    sums: list[int]
    span: int
    basis: np.ndarray
    values: np.ndarray
    trace: float
    error: float

    def numerators(self, x: np.ndarray) -> np.ndarray:
        """n*x - S, exact: 64-bit integers where they fit, else Python's."""
        if self.n * self.span < 1 << 62:
            return self.n * (x - SHIFT) - np.array([s - self.n * SHIFT for s in self.sums], np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def deviations(self, top: np.ndarray) -> list[int]:
        if top.dtype == object or (self.n * self.span) ** 2 * len(self.sums) >= 1 << 62:
            top = top.astype(object)
        return (top * top).sum(1).tolist()

    def centred(self, top: np.ndarray) -> np.ndarray:
        return (top / self.n).astype(float)


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of bounded size with their integer vectors as a matrix."""
    step = max(1, BATCH_NUMBERS // max(1, dims))
    for batch in batches:
        for lo in range(0, batch.num_rows, step):
            part = batch.slice(lo, step)
            c = part.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(float)
            yield part, np.floor(SCALE * c).astype(np.int64).reshape(part.num_rows, dims) + SHIFT


def _added(rows: DataFrame, dims: int, size: int, one: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of ``one(block of vectors)``, an array of ``size`` doubles."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for _, x in _blocks(batches, dims):
            total += one(x)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["v"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for row in range(batch.num_rows):
                total += batch.column("v").slice(row, 1).flatten().to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["v"])

    part = rows.select("embedding").mapInArrow(first, "v array<double>")
    return sum((np.array(r.v) for r in part.repartition(GROUPS).mapInArrow(again, "v array<double>").collect()), np.zeros(size))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part.

    Null vectors and those with null or non-finite entries (or entries whose integer has over 53 bits) do not, nor do
    vectors of another length than most have (of equally frequent lengths the larger one counts).
    """
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) >= LARGEST)
    rows = vectors.filter(F.col("embedding").isNotNull() & ~F.exists("embedding", bad)).select("vec_id", "embedding", F.size("embedding").alias("dims"))
    rows = written(rows)
    most = rows.groupBy("dims").count().orderBy(F.desc("count"), F.desc("dims")).first()
    return rows.filter(F.col("dims") == (most.dims if most else 0))


def fit(rows: DataFrame, most: int = 32, seed: int = 1) -> Model | None:
    """The model of all ``rows`` (of ``usable``); null without rows. Components of no variance are left out."""
    dims = rows.select("dims").first()
    if dims is None or not dims.dims:
        return None
    dims = dims.dims
    each = F.transform("embedding", lambda x: F.floor(SCALE * x.cast("double")) + SHIFT)
    held = rows.select(F.posexplode(each).alias("at", "x")).groupBy("at").agg(F.count("*").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("s"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy("at").collect()
    n, sums = held[0].n, [int(r.s) for r in held]
    model = Model(n, sums, max(r.high - r.low for r in held), np.zeros((dims, 0)), np.zeros(0), 0.0, 0.0)

    def power(basis: np.ndarray) -> np.ndarray:
        """(covariance x basis), and the covariance's trace behind it."""

        def one(x: np.ndarray) -> np.ndarray:
            a = model.centred(model.numerators(x))
            return np.append(a.T @ (a @ basis), (a * a).sum())

        return _added(rows, dims, dims * basis.shape[1] + 1, one) / n

    k = min(most, dims)
    rng = np.random.default_rng(seed)
    start = rng.standard_normal((dims, dims))
    basis = np.linalg.qr(start[:, : min(dims, k + OVERSAMPLING)])[0]
    for turn in range(PASSES + 1):
        if turn == PASSES:  # the residuals have failed: all dimensions
            basis = np.linalg.qr(np.hstack([basis, start[:, basis.shape[1] :]]))[0]
        out = power(basis)
        trace, moved = out[-1], out[:-1].reshape(dims, -1)
        small = basis.T @ moved
        values, turns = np.linalg.eigh((small + small.T) / 2)
        values, turns = values[::-1][:k], turns[:, ::-1][:, :k]
        found = basis @ turns
        residual = np.linalg.norm(moved @ turns - found * values, axis=0).max()
        if basis.shape[1] == dims or residual <= TOLERANCE * values[0]:
            break
        basis = np.linalg.qr(moved)[0]
    kept = values > dims * np.finfo(float).eps * max(values[0], 0.0)
    found = found[:, kept]
    k = found.shape[1]
    if k == 0:
        return Model(n, sums, model.span, found, np.zeros(0), trace, 0.0)

    def spread(x: np.ndarray) -> np.ndarray:
        p = model.centred(model.numerators(x)) @ found
        return np.concatenate([(p.T @ p).ravel(), p.sum(0)])

    out = _added(rows, dims, k * k + k, spread) / n
    cov = out[: k * k].reshape(k, k) - np.outer(out[k * k :], out[k * k :])
    values = np.diag(cov).copy()
    order = np.argsort(-values, kind="stable")
    found, values, cov = found[:, order], values[order], cov[np.ix_(order, order)]
    root = np.sqrt(values)
    return Model(n, sums, model.span, found, values, trace, float(np.abs(cov / np.outer(root, root) - np.eye(k)).max()))


def whiten(vectors: DataFrame, most: int = 32) -> DataFrame:
    """Per usable row and component (from 1, by falling eigenvalue, up to ``most``): vec_id, component, n, deviation,
    whitened, explained, identity_error.

    Rows that ``usable`` leaves out have no result; a null vec_id and repeated rows are rows like any other. Components
    whose eigenvalue is zero to double precision cannot be whitened and are left out, so one vector, or copies of one,
    give no row. Equal eigenvalues share their space in some order. The deviation is exact at any size.
    """
    rows = usable(vectors)
    model = fit(rows, most)
    empty = vectors.sparkSession.createDataFrame([], ROWS)
    if model is None or model.values.size == 0:
        return empty
    dims, k = len(model.sums), model.values.size
    share = (model.values / model.trace).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, dims):
            top = model.numerators(x)
            deviation = model.deviations(top)
            w = model.centred(top) @ model.basis / np.sqrt(model.values)
            m = part.num_rows
            at = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("vec_id").take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n, np.int64)),
                    pa.array(deviation, pa.decimal128(38, 0)).take(at), pa.array(w.ravel()), pa.array(share * m), pa.array(np.full(m * k, model.error)),
                ], names=[x.split()[0] for x in ROWS.split(", ")],
            )

    schema = ROWS.replace("bigint", rows.schema["vec_id"].dataType.simpleString(), 1)
    return rows.select("vec_id", "embedding").mapInArrow(run, schema)
