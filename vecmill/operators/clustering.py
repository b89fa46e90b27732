"""K-means in numpy, for centroids fitted on bounded samples."""

from __future__ import annotations

import numpy as np


def nearest(x: np.ndarray, c: np.ndarray, spherical: bool) -> np.ndarray:
    """The centroid closest to each row: by inner product if spherical, else by Euclidean distance."""
    half = 0 if spherical else 0.5 * np.einsum("ij,ij->i", c, c)
    return np.concatenate([np.argmax(x[i : i + 8192] @ c.T - half, axis=1) for i in range(0, len(x), 8192)] or [np.empty(0, np.int64)])


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator, spherical: bool) -> np.ndarray:
    """Lloyd's algorithm from k rows drawn at random; a centroid that loses all its rows keeps its place."""
    k = max(1, min(k, len(x)))
    c = x[rng.choice(len(x), k, replace=False)].astype(np.float32)
    for _ in range(rounds):
        near = nearest(x, c, spherical)
        order = np.argsort(near, kind="stable")
        count = np.bincount(near, minlength=k)
        full = np.flatnonzero(count)
        start = np.concatenate([[0], np.cumsum(count)[:-1]])
        c[full] = np.add.reduceat(x[order], start[full], axis=0) / count[full, None]
        if spherical:
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def best(scores: np.ndarray, n: int) -> np.ndarray:
    """Columns of the n largest scores in each row, in no order."""
    n = min(n, scores.shape[1])
    return np.argpartition(scores, scores.shape[1] - n, axis=1)[:, scores.shape[1] - n :]
