"""Embedding whitening: principal components of the covariance by QDWH divide and conquer, then a broadcast projection.

Method. Vectors are whole numbers, so their sums are exact. One pass adds up the products of the centred vectors by
matrix row; the covariance, of a size that depends on the vectors' length alone, is split on the driver (`spectral.py`).
The whitening matrix is broadcast and every vector is projected where it lies. The covariance of the whitened vectors is
summed in a pass of its own, and its distance from the identity is returned with each row.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.latent import sum_by_slice
from quire.llm.spectral import eigen
from quire.llm.store import generation
from quire.llm.vectors import blocks, integers, matrix

COMPONENTS = 8
OFFSET = 100_000
#: Vectors longer than this raise an error: their covariance is held on the driver.
LONGEST = 4096
#: Eigenvalues below this share of the largest count as zero; their directions can't be whitened.
NEGLIGIBLE = 1e-12

OUTPUT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def _rows_of(total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.arange(len(total), dtype=np.int64)), pa.array([r.tobytes() for r in total], pa.binary())],
        names=["slice", "sums"],
    )


def _sums(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1, size + 1), np.int64)
        for batch in blocks(batches):
            total[0, :size] += (matrix(batch.column("x"), size) + OFFSET).sum(axis=0)
            total[0, size] += batch.num_rows
        yield _rows_of(total)

    return run


def _products(shared, size: int):
    """Sums of products of the centred vectors, projected if a matrix is given, by matrix row; the last row sums the vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, project = shared.value
        width = size if project is None else project.shape[1]
        total = np.zeros((width + 1, width))
        for batch in blocks(batches):
            y = matrix(batch.column("x"), size) + OFFSET - mean
            if project is not None:
                y = y @ project
            total[:-1] += y.T @ y
            total[-1] += y.sum(axis=0)
        yield _rows_of(total)

    return run


def covariance(vectors: DataFrame, n: int, mean: np.ndarray, project: np.ndarray | None = None) -> np.ndarray:
    """Covariance (divisor n) of the vectors around the mean, or of their projections."""
    size = len(mean)
    width = size if project is None else project.shape[1]
    shared = vectors.sparkSession.sparkContext.broadcast((mean, project))
    partial = vectors.select("x").mapInArrow(_products(shared, size), "slice long, sums binary")
    total = np.zeros((width + 1, width))
    for r in sum_by_slice(partial, "<f8").collect():
        total[r["slice"]] = np.frombuffer(r["sums"], "<f8")
    rest = total[-1] / n  # the mean's own rounding
    return total[:-1] / n - np.outer(rest, rest)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """Sums over dimensions of (n * x - sums)^2, exact."""
    w = n * x - sums
    if not len(w) or float(np.abs(w).max()) ** 2 * x.shape[1] < 2.0**62:
        return pa.array(np.einsum("ij,ij->i", w, w)).cast(pa.decimal128(38, 0))
    high, low = w >> 31, w & ((1 << 31) - 1)
    parts = [np.einsum("ij,ij->i", p, q).tolist() for p, q in ((high, high), (high, low))]
    pieces = [low[:, k : k + 1].astype(object) ** 2 for k in range(x.shape[1])]
    ends = np.sum(pieces, axis=0)[:, 0]
    return pa.array([Decimal((a << 62) + (b << 32) + c) for a, b, c in zip(*parts, ends, strict=True)], pa.decimal128(38, 0))


def _whiten(shared, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, mean, project, explained, error = shared.value
        m = project.shape[1]
        for batch in blocks(batches):
            x = matrix(batch.column("x"), size) + OFFSET
            rows = len(x)
            each = pa.array(np.repeat(np.arange(rows), m))
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(each), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * m, n)), deviations(x, n, sums).take(each), pa.array(((x - mean) @ project).ravel()),
                pa.array(np.tile(explained, rows)), pa.array(np.full(rows * m, error)),
            ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error per usable vector and component.

    rows: vec_id, embedding; other columns are ignored. Vectors that are null, empty or hold a null or non-finite entry
    are dropped; of the others, those of the most frequent length are used (of equally frequent ones, the longest). An
    entry c becomes x = floor(1024 * c) + 100000. n counts the vectors, deviation is the sum over dimensions of
    (n * x - S)^2 with S the sum of all vectors (exact, a decimal), explained the component's share of the variance.
    Components are numbered by falling eigenvalue; directions without variance are left out, so equal vectors, a single
    vector or an empty table give no rows. Equal eigenvalues span a space of which any basis may come. Repeated rows
    count and come out as often as they go in; a null vec_id is kept. Vectors of over 4,096 entries or entries beyond
    131,072 in size raise an error.
    """
    spark = rows.sparkSession
    nothing = spark.createDataFrame([], OUTPUT)
    vectors, _ = generation(integers(rows), "vectors")
    lengths = vectors.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    if not lengths:
        return nothing
    size = lengths[0]["size"]
    if size > LONGEST:
        raise ValueError(f"vectors of {size} entries are longer than {LONGEST}")
    vectors = vectors.filter(F.col("size") == size)
    total = np.frombuffer(sum_by_slice(vectors.select("x").mapInArrow(_sums(size), "slice long, sums binary"), "<i8").collect()[0]["sums"], "<i8")
    n, sums = int(total[-1]), total[:-1]
    mean = sums / n
    matrix_of = covariance(vectors, n, mean)
    values, directions = eigen(matrix_of, components)
    good = values > NEGLIGIBLE * max(values[0], 0)
    values, directions = values[good], directions[:, good]
    if not len(values) or values[0] <= 0:
        return nothing
    project = directions / np.sqrt(values)
    error = float(np.abs(covariance(vectors, n, mean, project) - np.eye(len(values))).max())
    shared = spark.sparkContext.broadcast((n, sums, mean, project, values / np.trace(matrix_of), error))
    return vectors.select("vec_id", "x").mapInArrow(_whiten(shared, size), OUTPUT)
