"""Array-vector expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def unit(a: Column) -> Column:
    n = F.greatest(norm(a), F.lit(1e-8))
    return F.transform(a, lambda x: x.cast("double") / n)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(1e-8)) * F.greatest(norm(b), F.lit(1e-8)))


def weighted(a: Column, weights: Column) -> Column:
    """Unit vector of a vector under a diagonal metric."""
    return unit(F.zip_with(a, weights, lambda x, w: x.cast("double") * w))


def metric_weights(vectors, labels, groups, epochs: int = 60, rate: float = 0.035):
    """Diagonal metric for cosine by batch-hard triplets on a few examples (numpy arrays): vectors of one label and different groups are to
    be nearer than those of other labels by .08. Weights have mean 1; all 1 with fewer than four usable anchors. Fixed
    values: the margin, the regulariser and the limits."""
    import numpy as np

    x, labels, groups = np.asarray(vectors, float), np.asarray(labels), np.asarray(groups)
    same = labels[:, None] == labels[None, :]
    positive, negative = same & (groups[:, None] != groups[None, :]), ~same
    valid = positive.any(1) & negative.any(1)
    dim = x.shape[1]
    if valid.sum() < 4 or epochs <= 0:
        return np.ones(dim)
    z, m, v = np.zeros(dim), np.zeros(dim), np.zeros(dim)
    rows = np.flatnonzero(valid)
    for step in range(1, epochs + 1):
        w = np.log1p(np.exp(z)) + 1e-4
        p = x * w
        norm = np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12)
        u = p / norm
        s = u @ u.T
        near = np.where(positive, s, 2.0).argmin(1)
        far = np.where(negative, s, -2.0).argmax(1)
        hit = rows[0.08 + s[rows, far[rows]] - s[rows, near[rows]] > 0]
        g = np.zeros_like(u)  # gradient of the loss by unit vectors
        for i in hit:
            g[i] += (u[far[i]] - u[near[i]]) / len(rows)
            g[far[i]] += u[i] / len(rows)
            g[near[i]] -= u[i] / len(rows)
        gp = (g - (g * u).sum(1, keepdims=True) * u) / norm
        grad = (gp * x).sum(0) / (1 + np.exp(-z)) + 0.02 * z / dim
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        z -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    w = np.log1p(np.exp(z)) + 1e-4
    return np.clip(w / max(1e-8, w.mean()), 0.15, 6.0)
