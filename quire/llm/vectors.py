"""Numeric vectors as integer rows: cleaned, scaled and packed as bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 1024
#: Scaled entries beyond this bound raise an error: squared distances would leave 64 bits.
LARGEST = 1 << 27


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(1)
        n = len(lists)
        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = pc.fill_null(pc.cast(lists.flatten(), pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size)
        wrong = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
        good = (size > 0) & (wrong[ends] == wrong[ends - size])
        x = np.floor(SCALE * flat[np.repeat(good, size)])
        if len(x) and np.abs(x).max() > LARGEST:
            raise ValueError(f"a vector entry is beyond {LARGEST // SCALE} in size")
        bounds = np.concatenate([[0], np.cumsum(4 * size[good])]).astype(np.int32)
        blob = pa.Array.from_buffers(
            pa.binary(), int(good.sum()), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(x.astype("<i4").tobytes())]
        )
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).filter(pa.array(good)), pa.array(size[good].astype(np.int32)), blob], names=["vec_id", "size", "x"]
        )


def integers(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, size, x: floor(1024 * entry) of each usable vector as little-endian 32-bit integers.

    Vectors that are null or empty or hold a null or non-finite entry are left out. Other columns are ignored.
    """
    source = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v"))
    return source.mapInArrow(_pack, "vec_id long, size int, x binary")


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """Blobs of `size` numbers each as one integer matrix."""
    n = len(column)
    if not n:
        return np.zeros((0, size), np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data.view("<i4").reshape(n, size).astype(np.int64)


def blocks(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Batches of bounded length."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)
