import hashlib
import math
import random

import numpy as np
import pytest

from quire.llm import centroids
from tests.llm.conftest import CLASHES

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute_force(rows, k, rounds, size):
    """Plain Lloyd rounds in whole numbers; rows: (vec_id, entries)."""
    kept = [
        (v, tuple(math.floor(1024 * e) for e in x)) for v, x in rows
        if x is not None and len(x) == size and all(e is not None and math.isfinite(e) for e in x)
    ]
    packed = lambda x: np.array(x, "<i4").tobytes()
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", packed(r[1])))
    centres = [x for _, x in first[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        own = [nearest(x)[1] for _, x in kept]
        for j in range(len(centres)):
            mine = [x for (_, x), o in zip(kept, own, strict=True) if o == j]
            if mine:
                centres[j] = tuple(sum(column) // len(mine) for column in zip(*mine, strict=True))
    final = [(v, *nearest(x)) for v, x in kept]
    inertia = sum(d for _, d, _ in final)
    return sorted([
        (v, j, d, sum(e for _, e, i in final if i == j), inertia, hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest())
        for v, d, j in final
    ], key=str)


def as_float(x):
    return None if x is None else [None if e is None else float(np.float32(e)) for e in x]


def sample(rng, n, size, groups=5, spread=0.3):
    middle = rng.normal(size=(groups, size))
    return [(v, as_float(middle[v % groups] + spread * rng.normal(size=size))) for v in range(n)]


ODD = [
    (9000, None), (9001, []), (9002, [0.5] * 5), (9003, [None] + [0.25] * 5), (9004, [math.nan] + [0.1] * 5),
    (9005, [math.inf] + [0.1] * 5), (9006, [0.0] * 6), (9006, [0.0] * 6), (None, [0.1] * 6), (9007, [-0.0] * 6), (9008, [1e-9] * 6), (9009, [-1e-9] * 6),
]


@pytest.mark.parametrize("seed, spread", [(1, 0.3), (2, 1.0), (3, 0.0)])
def test_rounds_equal_brute_force(table, seed, spread):
    rows = sample(np.random.default_rng(seed), 300, 6, spread=spread) + [(v, as_float(x)) for v, x in ODD]
    report = []
    got = centroids.cluster(table([(*r, 0) for r in rows], SCHEMA, extra=True), size=6, report=report).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute_force(rows, 8, 10, 6)
    assert len(report) == 11 and sum(report) < 11 * report[0]


def test_bounds_skip_distances_and_total_displacement_is_what_loosens_them():
    rng = np.random.default_rng(4)
    x = rng.integers(-1000, 1000, (2000, 8)) + 20000 * rng.integers(0, 4, 2000)[:, None]
    centres = np.array([[20000 * j] * 8 for j in range(4)])
    state, computed = centroids.start(x, centres)
    assert computed == 8000
    history = centres[None]
    for r in range(1, 6):  # out and back: summed drifts grow, total displacement returns to nothing
        history = np.concatenate([history, (centres + (9000 if r % 2 else 0))[None]])
        computed = centroids.advance(x, state, history)
        exact = np.stack([centroids.squared(x, c) for c in history[-1]], axis=1)
        assert (state.cluster == exact.argmin(axis=1)).all()
        if r % 2 == 0:
            assert computed == 0


def test_ties_go_to_the_smaller_number():
    x = np.array([[0, 0], [10, 0], [5, 0]])
    state, _ = centroids.start(x, np.array([[0, 0], [10, 0], [0, 0]]))
    assert state.cluster.tolist() == [0, 1, 0]
    history = np.array([[[0, 0], [10, 0], [0, 0]], [[10, 0], [0, 0], [0, 0]]])
    centroids.advance(x, state, history)
    assert state.cluster.tolist() == [1, 0, 0]


def test_a_hot_vector_few_vectors_and_empty_tables(table):
    rng = random.Random(6)
    rows = [(v, [0.5] * 6) for v in range(200)] + [(v, as_float([rng.random() for _ in range(6)])) for v in range(200, 240)]
    got = centroids.cluster(table([(*r, 0) for r in rows], SCHEMA), size=6).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute_force(rows, 8, 10, 6)
    few = rows[:1] + rows[-2:]
    got = centroids.cluster(table([(*r, 0) for r in few], SCHEMA), size=6).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute_force(few, 8, 10, 6) and {r.cluster for r in got} == {0, 1, 2}
    none = centroids.cluster(table([], SCHEMA))
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert centroids.cluster(table([(1, None, 0), (2, [0.1], 0)], SCHEMA)).count() == 0
    assert "distance" not in CLASHES  # clashing names are ignored, as only vec_id and embedding are read


def test_entries_that_would_leave_64_bits_are_refused(table):
    with pytest.raises(Exception, match="beyond 131072 in size"):
        centroids.cluster(table([(1, [3e38] * 6, 0)], SCHEMA), size=6).collect()
