"""Eigenvectors of a symmetric matrix by QDWH spectral divide and conquer.

The polar factor of A - shift * I has the eigenvectors of A with the signs of their shifted eigenvalues, so half of it
plus half the identity projects on the invariant subspace above the shift. QDWH finds the factor in six or seven
QR-based rounds whatever the condition. A basis of the projector's range and of its complement splits A into two
smaller matrices, which are split in turn until they are multiples of the identity.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps


def polar_sign(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix: its matrix sign."""
    n = len(a)
    x = a / np.linalg.norm(a)
    low = EPS / 10  # a bound below the smallest singular value that still has a sign
    for _ in range(20):
        gap = (4 * (1 - low**2) / low**4) ** (1 / 3)
        root = np.sqrt(1 + gap)
        wa = root + np.sqrt(8 - 4 * gap + 8 * (2 - low**2) / (low**2 * root)) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q = np.linalg.qr(np.concatenate([np.sqrt(wc) * x, np.eye(n)]))[0]
        y = (wb / wc) * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        y = (y + y.T) / 2
        low = min(1.0, low * (wa + wb * low**2) / (1 + wc * low**2))
        change = np.linalg.norm(y - x)
        x = y
        if change < EPS ** (1 / 3) and 1 - low < 1e-12:
            break
    return 1.5 * x - 0.5 * (x @ x @ x)


def _split(a: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of an invariant subspace of larger eigenvalues and of its complement; None if there is no gap."""
    n = len(a)
    values = np.diag(a)
    mean = values.mean()
    spread = np.linalg.norm(a - mean * np.eye(n)) / np.sqrt(n)
    if spread <= 4 * EPS * scale:
        return None
    rng = np.random.default_rng(n)
    for step in (0, 0.25, -0.25, 0.5, -0.5, 0.75, -0.75, 0.1, -0.1, 0.9, -0.9):  # an eigenvalue may lie at the shift
        projector = (polar_sign(a - (mean + step * spread) * np.eye(n)) + np.eye(n)) / 2
        k = round(float(np.trace(projector)))
        if not 0 < k < n or np.linalg.norm(projector @ projector - projector) > 1e-9:
            continue
        basis = projector @ rng.normal(size=(n, k))
        for _ in range(2):
            basis = projector @ np.linalg.qr(basis)[0]
        whole = np.linalg.qr(basis, mode="complete")[0]
        upper, lower = whole[:, :k], whole[:, k:]
        if np.linalg.norm(lower.T @ a @ upper) <= 50 * n * EPS * scale:
            return upper, lower
    return None


def eigen(a: np.ndarray, wanted: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of a symmetric matrix by falling value; only the `wanted` largest are split out."""
    a = (a + a.T) / 2
    n = len(a)
    wanted = n if wanted is None else min(wanted, n)
    scale = float(np.linalg.norm(a))
    values, vectors = [], []
    parts = [(a, np.eye(n))]  # subspaces still to split, the one of the largest values last
    while parts and len(values) < wanted:
        own, basis = parts.pop()
        halves = _split(own, scale) if len(own) > 1 and scale > 0 else None
        if halves is None:
            order = np.argsort(-np.diag(own), kind="stable")
            values += np.diag(own)[order].tolist()
            vectors += list(basis[:, order].T)
            continue
        upper, lower = halves
        for q in (lower, upper):
            part = q.T @ own @ q
            parts.append(((part + part.T) / 2, basis @ q))
    order = np.argsort(-np.array(values), kind="stable")[:wanted]
    return np.array(values)[order], np.array(vectors).reshape(-1, n)[order].T
