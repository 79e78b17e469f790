import math
from decimal import Decimal

import numpy as np
import pytest

from quire.llm import spectral, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def symmetric(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))[0]
    return (q * np.array(values, float)) @ q.T


@pytest.mark.parametrize("values", [
    np.arange(64) ** 2 + 1.0, [5.0, 1.0], [7.0], [3.0] * 12, [3.0] * 5 + [2.0] * 5 + [1.0] * 5, [1e9, 1.0, 1e-3, 0, 0, 0],
    [-4.0, -1.0, 0.0, 1.0, 4.0], 10.0 ** -np.arange(12), [1.0, 1.0 + 1e-9, 1.0 - 1e-9, 2.0], np.zeros(4),
])
def test_eigenpairs(values):
    a = symmetric(values)
    found, vectors = spectral.eigen(a)
    scale = max(np.abs(values).max(), 1e-300)
    assert np.allclose(found, np.sort(values)[::-1], rtol=0, atol=1e-12 * scale)
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-13 * len(values))
    assert np.abs(a @ vectors - vectors * found).max() <= 1e-12 * scale
    top, some = spectral.eigen(a, 3)
    assert np.allclose(top, found[:3], rtol=0, atol=1e-12 * scale) and some.shape == (len(values), min(3, len(values)))


def test_polar_factor_is_the_matrix_sign():
    for values in ([3.0, -1e-9, 2.0, -5.0], [1.0, -1.0], [1e2, 1e-4, -1e-4]):
        sign = spectral.polar_sign(symmetric(values, 3))
        assert np.allclose(sign, symmetric(np.sign(values), 3), atol=1e-6)
        assert np.allclose(sign @ sign, np.eye(len(values)), atol=1e-12)


def brute_force(rows, components=8):
    kept = [(v, x) for v, x in rows if x and all(e is not None and math.isfinite(e) for e in x)]
    x = np.array([[math.floor(1024 * e) + 100000 for e in x] for _, x in kept])
    n, sums = len(x), x.sum(axis=0)
    y = x - sums / n
    cov = y.T @ y / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    exact = [sum((n * int(e) - int(s)) ** 2 for e, s in zip(r, sums, strict=True)) for r in x]
    return [v for v, _ in kept], n, exact, y @ vectors / np.sqrt(values), values / np.trace(cov)


ODD = [(9000, None), (9001, []), (9003, [None] + [0.25] * 15), (9004, [math.nan] + [0.1] * 15), (9005, [0.1] * 15 + [-math.inf])]


def sample(n=500, size=16, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, size)) * (1 + np.arange(size)[::-1] / 4) @ np.linalg.qr(rng.normal(size=(size, size)))[0]
    return [(v, [float(np.float32(e)) for e in r]) for v, r in enumerate(x)]


def test_rows_equal_brute_force(table):
    rows = sample() + ODD + [(None, sample()[0][1]), (7, sample()[7][1])]
    ids, n, exact, white, explained = brute_force(rows)
    got = whitening.whiten(table([(*r, 0) for r in rows], SCHEMA, extra=True)).collect()
    assert len(got) == 8 * len(ids) and {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, 9))
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    sign = {}
    first = {v: k for k, v in reversed(list(enumerate(ids)))}
    for r in got:
        k = first[r.vec_id]
        want = white[k, r.component - 1]
        sign.setdefault(r.component, np.sign(r.whitened * want))
        assert r.deviation == exact[k]
        assert abs(r.whitened * sign[r.component] - want) < 1e-9 and abs(r.explained / explained[r.component - 1] - 1) < 1e-9


def test_deviations_beyond_64_bits_are_exact():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 200000, (50, 64))
    n = 10**10
    sums = x.mean(axis=0).astype(np.int64) * n + 12345
    got = whitening.deviations(x, n, sums).to_pylist()
    assert got == [Decimal(sum((n * int(e) - int(s)) ** 2 for e, s in zip(r, sums, strict=True))) for r in x]
    assert max(got) > 1 << 63


def test_flat_lengths_and_empty_tables(table):
    columns = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in ([], [(1, None, 0)], [(1, [0.5, 0.5], 0)], [(k, [0.5, 0.5], 0) for k in range(9)]):
        found = whitening.whiten(table(rows, SCHEMA))
        assert found.columns == columns and found.count() == 0
    line = [(k, [k / 8, -k / 8, 0.0], 0) for k in range(20)] + [(99, [1.0], 0)]  # one direction; the odd length is dropped
    found = whitening.whiten(table(line, SCHEMA)).collect()
    assert len(found) == 20 and {r.component for r in found} == {1} and abs(found[0].explained - 1) < 1e-9
