"""Centroid clustering with ns-bounds over exact integer vectors.

Method. Lloyd's rounds, but a distance is computed only where bounds can't settle it. Each vector keeps, per centroid,
the distance at the round it was last computed, and the number of that round. Centroids of all rounds are kept, so a
stored distance is loosened by the norm of the centroid's *total* displacement since that round (ns-bounds), which
never exceeds the sum of the rounds' drifts. A vector whose own distance, so loosened, stays below all others keeps its
centroid unread. Otherwise its own distance is computed afresh, and then those of the centroids that are still in doubt,
in exact integers, smaller numbers first among equals.

Every round is one pass that writes the vectors' next state and, beside them, each task's sums per cluster; the sums
are added up in Spark and only k rows reach the driver. The state of the round before is then removed. Stored
distances have 32 bits; the bounds leave room for their rounding, so the result is that of exact rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.latent import sum_by_slice
from quire.llm.store import generation, written
from quire.llm.vectors import blocks, integers, matrix

CLUSTERS, ROUNDS, SIZE = 8, 10, 64
_LOOSE = 1e-6  # above the rounding of stored distances

STATE = "vec_id long, x binary, cluster int, seen binary, at binary, sums binary"


def squared(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to a centroid, or to a centroid each."""
    d = x - centre
    return np.einsum("ij,ij->i", d, d)


class State:
    """What is known of some vectors: assigned centroid, last computed distances and the rounds they are from."""

    def __init__(self, cluster: np.ndarray, seen: np.ndarray, at: np.ndarray):
        self.cluster, self.seen, self.at = cluster, seen, at


def start(x: np.ndarray, centres: np.ndarray) -> tuple[State, int]:
    """All distances of the first round, and how many they are."""
    all_of = np.stack([squared(x, c) for c in centres], axis=1)
    state = State(all_of.argmin(axis=1), np.sqrt(all_of).astype("<f4"), np.zeros(all_of.shape, "<u2"))
    return state, all_of.size


def advance(x: np.ndarray, state: State, history: np.ndarray) -> int:
    """Bring the state to the newest round of the history; the number of distances computed."""
    now, k = len(history) - 1, history.shape[1]
    moved = np.linalg.norm((history[now] - history).astype(float), axis=2)  # by round and centroid
    every = np.arange(len(x))
    seen = state.seen.astype(float)
    off = moved[state.at, np.arange(k)] * (1 + 1e-9)
    own = state.cluster
    upper = seen[every, own] * (1 + _LOOSE) + off[every, own]
    lower = seen * (1 - _LOOSE) - off
    doubt = lower <= upper[:, None]
    doubt[every, own] = False
    rows = np.flatnonzero(doubt.any(axis=1))
    if not len(rows):
        return 0
    found = np.full((len(rows), k), np.iinfo(np.int64).max)
    mine = own[rows]
    found[np.arange(len(rows)), mine] = squared(x[rows], history[now][mine])
    exact = np.sqrt(found[np.arange(len(rows)), mine].astype(float))
    again, centre = np.nonzero(doubt[rows] & (lower[rows] <= (exact * (1 + _LOOSE))[:, None]))
    for j in range(k):
        some = again[centre == j]
        found[some, j] = squared(x[rows[some]], history[now][j])
    done = found < np.iinfo(np.int64).max
    at_row, at_centre = np.nonzero(done)
    state.seen[rows[at_row], at_centre] = np.sqrt(found[done].astype(float))
    state.at[rows[at_row], at_centre] = now
    state.cluster[rows] = found.argmin(axis=1)
    return int(done.sum())


def _blobs(values: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    n, width = len(values), values.shape[1] * values.itemsize
    bounds = np.arange(n + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(values.tobytes())])


def _unblob(column: pa.Array, kind: str, k: int) -> np.ndarray:
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind).reshape(n, k).copy()


def _step(shared):
    """One round: next state of each vector, then a row of sums per cluster (entries, vectors, distances computed)."""
    kinds = pa.schema([
        ("vec_id", pa.int64()), ("x", pa.binary()), ("cluster", pa.int32()), ("seen", pa.binary()), ("at", pa.binary()),
        ("sums", pa.binary()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        history = shared.value
        k, size = history.shape[1:]
        total = np.zeros((k, size + 2), np.int64)
        for batch in blocks(batches):
            x = matrix(batch.column("x"), size)
            if len(history) == 1:
                state, computed = start(x, history[0])
            else:
                state = State(
                    batch.column("cluster").to_numpy(zero_copy_only=False).copy(),
                    _unblob(batch.column("seen"), "<f4", k), _unblob(batch.column("at"), "<u2", k),
                )
                computed = advance(x, state, history)
            for j in range(k):
                some = x[state.cluster == j]
                total[j, :size] += some.sum(axis=0)
                total[j, size] += len(some)
            total[0, size + 1] += computed
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id"), batch.column("x"), pa.array(state.cluster.astype(np.int32)),
                _blobs(state.seen), _blobs(state.at), pa.nulls(len(x), pa.binary()),
            ], schema=kinds)
        yield pa.RecordBatch.from_arrays([
            pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(np.arange(k, dtype=np.int32)),
            pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary()), _blobs(total),
        ], schema=kinds)

    return run


def _distances(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        for batch in blocks(batches):
            x = matrix(batch.column("x"), centres.shape[1])
            own = batch.column("cluster").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("cluster"), pa.array(squared(x, centres[own]))],
                names=["vec_id", "cluster", "distance"],
            )

    return run


def _first_centres(vectors: DataFrame, clusters: int, size: int, seed: int) -> np.ndarray:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    top = vectors.select(digest.alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(clusters).collect()
    return np.array([np.frombuffer(r["x"], "<i4") for r in top], np.int64).reshape(len(top), size)


def cluster(
    rows: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, seed: int = 3, report: list | None = None
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 per usable vector.

    rows: vec_id, embedding; other columns are ignored. Usable are vectors of exactly `size` entries, none null or
    non-finite; entries become floor(1024 * entry). Centroids begin as the vectors with the smallest sha256 of
    "<seed>:<vec_id>" (null ids last, equal ids by their bytes); fewer vectors than clusters give fewer centroids. After each
    round a centroid is the floor of its vectors' mean, or stays where it has none. Equal distances go to the smaller
    number. Repeated rows count and come out as often as they go in. An empty table gives no rows. Entries beyond
    131,072 in size raise an error, as distances would leave 64 bits. `report` takes the number of distances computed
    in each round.
    """
    spark = rows.sparkSession
    usable = integers(rows).filter(F.col("size") == size).select("vec_id", "x")
    vectors, path = generation(usable, "vectors")
    centres = _first_centres(vectors, clusters, size, seed)
    k = len(centres)
    if not k:
        return spark.createDataFrame(
            [], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        )
    history = centres[None]
    state = vectors.withColumns({c: F.lit(None).cast(t) for c, t in (("cluster", "int"), ("seen", "binary"), ("at", "binary"))})
    for r in range(rounds + 1):
        shared = spark.sparkContext.broadcast(history)
        state, path = generation(state.mapInArrow(_step(shared), STATE), "state", path)
        sums = state.filter("sums IS NOT NULL").select(F.col("cluster").cast("long").alias("slice"), "sums")
        total = np.zeros((k, size + 2), np.int64)
        for row in sum_by_slice(sums, "<i8").collect():
            total[row["slice"]] = np.frombuffer(row["sums"], "<i8")
        if report is not None:
            report.append(int(total[0, -1]))
        state = state.filter("x IS NOT NULL").drop("sums")
        if r < rounds:
            count = total[:, size : size + 1]
            centres = np.where(count > 0, total[:, :size] // np.maximum(count, 1), history[-1])
            history = np.concatenate([history, centres[None]])
    shared = spark.sparkContext.broadcast(history[-1])
    found = written(state.mapInArrow(_distances(shared), "vec_id long, cluster int, distance long"), "clustered")
    each = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    named = [(j, s, sum(each.values()), hashlib.sha256(",".join(map(str, history[-1][j].tolist())).encode()).hexdigest()) for j, s in each.items()]
    known = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(known), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
