"""Whitening of embeddings: an exact centre, a distributed Gramian, a small eigenproblem, a broadcast projection.

Entries are put on a grid of whole numbers, so that counts, sums and deviations are exact however the rows are split.
Rows are centred before they are multiplied (n times the row less the sum, all whole numbers), which keeps the covariance free of the
cancellation that the difference of two large sums would have. RowMatrix adds up the outer products in the
JVM; the driver gets one matrix of dimensions x dimensions and solves it, and the projection goes back as a broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Steps of the grid per unit, and what is added so that whole numbers are positive.
GRID, SHIFT = 64, 1_000_000


@dataclass(frozen=True)
class Whitening:
    """n: rows of the fit. sums: their exact sums per dimension. directions: unit eigenvectors as columns, by falling eigenvalue.
    values: their eigenvalues. trace: of the whole covariance."""

    n: int
    sums: np.ndarray
    directions: np.ndarray
    values: np.ndarray
    trace: float

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Rows of whole numbers, projected and scaled to unit variance."""
        return ((x * self.n - self.sums) / self.n) @ (self.directions / np.sqrt(self.values))


def whole(docs: DataFrame, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, x of every usable row: x = floor(GRID * entry) + SHIFT for each entry.

    Null vectors, empty ones and those with a null, NaN or infinite entry are left out; so are vectors shorter than the longest of
    the others, which lack entries. An entry whose grid number is no long is an arithmetic error.
    """
    c = F.col("c")
    good = F.forall("c", lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) != float("inf")), F.lit(False)))
    rows = docs.select(F.col(id_).alias("id"), F.col(vector).cast("array<double>").alias("c")).where((F.size(c) > 0) & good)
    longest = rows.agg(F.max(F.size(c)).alias("d")).scalar()
    return rows.where(F.size(c) == longest).select("id", F.transform(c, lambda e: F.floor(e * GRID) + SHIFT).alias("x"))


def matrix_of(column: pa.Array) -> np.ndarray:
    """A column of lists of equal length as rows."""
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def exact_sums(x: DataFrame) -> tuple[int, np.ndarray]:
    """(n, sums per dimension), by partial sums per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = matrix_of(batch.column("x"))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(m.shape[1])), pa.array(np.full(m.shape[1], len(m))), pa.array(m.sum(axis=0))], ["k", "n", "s"])

    parts = x.select("x").mapInArrow(run, "k long, n long, s long")
    found = parts.groupBy("k").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("k").collect()  # a row per dimension
    return (found[0]["n"] if found else 0), np.array([r["s"] for r in found], np.int64)


def fit(x: DataFrame, components: int = 32) -> Whitening | None:
    """The whitening of x (from whole()); None for no rows.

    Directions of an eigenvalue that is rounding error beside the largest (rows in fewer dimensions than they have entries, or
    equal rows) do not count as components: their rows would be divided by nothing.
    """
    n, sums = exact_sums(x)
    if not n:
        return None
    centred = x.select(F.transform("x", lambda e, i: (e * n - F.get(F.lit(sums.tolist()), i.cast("int"))).cast("double")).alias("v"))
    rows = MLUtils.convertVectorColumnsFromML(centred.select(array_to_vector("v").alias("v")), "v")
    # rows are n times too long, so their products n * n times, and the mean takes another n
    v = RowMatrix(rows).computeGramianMatrix().toArray() / n / n / n
    values, directions = np.linalg.eigh((v + v.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > len(v) * np.finfo(float).eps * max(values.max(), 0.0)]
    return Whitening(n, sums, directions[:, order], values[order], float(np.trace(v)))


def identity_error(x: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of x's whitened rows (centred, divisor n) minus the identity, measured over all rows."""
    k = len(model.values)
    if not k:
        return 0.0
    shared = x.sparkSession.sparkContext.broadcast(model)

    def centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                w = shared.value.apply(matrix_of(batch.column("x")))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(w.sum(axis=0))], ["k", "s"])

    means = np.array([r["s"] for r in x.select("x").mapInArrow(centre, "k long, s double").groupBy("k").agg(F.sum("s").alias("s")).orderBy("k").collect()]) / model.n
    centres = x.sparkSession.sparkContext.broadcast(means)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                w = shared.value.apply(matrix_of(batch.column("x"))) - centres.value
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array((w.T @ w).ravel())], ["k", "s"])

    cov = np.array([r["s"] for r in x.select("x").mapInArrow(products, "k long, s double").groupBy("k").agg(F.sum("s").alias("s")).orderBy("k").collect()]) / model.n
    return float(np.abs(cov.reshape(k, k) - np.eye(k)).max())


def whiten(docs: DataFrame, components: int = 32, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error for every usable row and component.

    The covariance is fitted on all usable rows. deviation: the exact sum over dimensions of (n x - sum) ** 2; numbers that a long cannot
    hold are an error, not wrapped. explained: the component's share of the trace. Rows that whole() leaves out give no rows, nor does a
    table without usable rows or one whose usable rows are all equal (it has no component). Null ids pass through, repeated rows and ties
    count and come out each for itself, columns other than the two named are ignored. Components have the sign that makes their
    largest entry positive, the same for all rows.
    """
    x, kind = whole(docs, id_, vector), docs.schema[id_].dataType.simpleString()
    schema = f"`{id_}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(x, components)
    if model is None or not len(model.values):
        return docs.sparkSession.createDataFrame([], schema)
    top = np.abs(model.directions).argmax(axis=0)
    model = Whitening(model.n, model.sums, model.directions * np.sign(model.directions[top, np.arange(len(top))]), model.values, model.trace)
    k, error = len(model.values), identity_error(x, model)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for f in frames:
            for at in range(0, len(f), 1024):
                part = f.iloc[at : at + 1024]
                rows = np.stack(part["x"].to_numpy())
                yield pd.DataFrame(
                    {
                        id_: part["id"].repeat(k).to_numpy(),
                        "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(part)),
                        "n": m.n,
                        "deviation": np.repeat(squares(rows, m), k),
                        "whitened": m.apply(rows).ravel(),
                        "explained": np.tile(m.values / m.trace, len(part)),
                        "identity_error": error,
                    }
                )

    return x.mapInPandas(run, schema)


def squares(x: np.ndarray, model: Whitening) -> np.ndarray:
    """Sum over dimensions of (n x - sum) ** 2, exact: in longs where they can hold it, else in Python's whole numbers."""
    far = x * model.n - model.sums
    if float(np.abs(far).max(initial=0)) ** 2 * far.shape[1] < 2**62:
        return (far * far).sum(axis=1)
    return np.array([sum(int(e) ** 2 for e in row) for row in far], np.int64)  # raises where a sum is no long
