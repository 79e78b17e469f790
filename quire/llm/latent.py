"""Distributed randomised SVD: leading right singular directions of a sparse matrix whose rows lie in a DataFrame."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.words import mix
from quire.llm.workers import releasing

EXTRA, ROUNDS = 16, 2


def summed(kind: str):
    """Arrow task: blobs of numbers that agree in the first column are added up, one at a time."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                values = np.frombuffer(blob, kind)
                if k in total:
                    total[k] += values
                else:
                    total[k] = values.copy()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())],
            names=["slice", "sums"],
        )

    return run


def sum_by_slice(partial: DataFrame, kind: str) -> DataFrame:
    """(slice, sums) of rows (slice, sums): element-wise sums of the blobs of each slice."""
    return partial.repartition("slice").mapInArrow(summed(kind), "slice long, sums binary")


def _random_columns(columns: np.ndarray, size: int) -> np.ndarray:
    """The rows of the random test matrix for the given features: signs from a hash, the same on every executor."""
    with np.errstate(over="ignore"):
        bits = mix(columns.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(size, dtype=np.uint64))
    return np.where(bits >> np.uint64(63), 1.0, -1.0)


def _product(size: int, shared):
    """Partial sums of A' A X by feature, for the random test matrix (nothing shared) or a given X."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, given = shared.value
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for columns, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                columns, values = np.array(columns, np.int64), np.array(values)
                if len(columns):
                    own = _random_columns(columns, size) if given is None else given[np.searchsorted(keys, columns)]
                    out = values[:, None] * (values @ own)[None, :]
                    for c, r in zip(columns.tolist(), out, strict=True):
                        if c in held:
                            held[c] += r
                        else:
                            held[c] = r
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int64()), pa.array([v.tobytes() for v in held.values()], pa.binary())],
            names=["slice", "sums"],
        )

    return run


def directions(rows: DataFrame, rank: int, extra: int = EXTRA, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(features, vectors) of the matrix with rows (columns array<long>, values array<double>).

    Randomised subspace iteration: each round is one distributed product A' A X, summed by feature, and an
    orthonormalisation of its columns on the driver. What comes back is one vector per feature, so the caller bounds
    the number of features. No rows, or rows of zeros, give no directions.
    """
    spark = rows.sparkSession
    size = rank + extra
    keys = given = None
    values = np.zeros(0)
    for _ in range(rounds + 1):
        shared = spark.sparkContext.broadcast((keys, given))
        partial = rows.select("columns", "values").mapInArrow(_product(size, shared), "slice long, sums binary")
        found = sorted(sum_by_slice(partial, "<f8").collect())
        if not found:
            return np.zeros(0, np.int64), np.zeros((0, 0), np.float32)
        keys = np.array([r[0] for r in found])
        z = np.stack([np.frombuffer(r[1], "<f8") for r in found])
        given, values, _ = np.linalg.svd(z, full_matrices=False)
    good = values > 1e-9 * max(values[0], 1e-300)
    return keys, given[:, good][:, :rank].astype(np.float32)
