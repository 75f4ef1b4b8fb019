"""Least squares from cross products.

Spark sums the products of the design columns per key (map-side combined, inside
generated code); what reaches Python is one small matrix per key.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, functions as F


def cross_products(cols: list[str], use: str | None) -> Column:
    """Aggregate: upper triangle of ``sum(z_i z_j)`` over the rows with ``use``, row by row.

    Written as one SQL text: a wide design has over a hundred sums.
    """
    def cell(a: str, b: str) -> str:
        return f"sum(case when {use} then {a} * {b} end)" if use else f"sum({a} * {b})"

    cells = [f"coalesce({cell(a, b)}, 0d)" for i, a in enumerate(cols) for b in cols[i:]]
    return F.expr(f"array({', '.join(cells)})")


def unpack(cells, size: int) -> np.ndarray:
    """Full symmetric matrix from the upper triangle."""
    full = np.zeros((size, size))
    upper = _triangle(size)
    full[upper] = cells
    full[upper[::-1]] = cells
    return full


@lru_cache
def _triangle(size: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(size)


def least_squares(gram: np.ndarray, use: list[int]) -> tuple[np.ndarray, float]:
    """Regress column 0 on the columns ``use``: coefficients and residual sum of squares.

    The columns are brought to unit length first. A singular system is solved in
    the minimum-norm sense.
    """
    yy = float(gram[0, 0])
    if not use:
        return np.empty(0), yy
    a, b = gram[np.ix_(use, use)], gram[use, 0]
    length = np.sqrt(np.diag(a))
    length[length == 0] = 1.0
    scaled = a / np.outer(length, length)
    if np.linalg.cond(scaled) < 1e12:
        beta = np.linalg.solve(scaled, b / length) / length
    else:
        beta = np.linalg.pinv(scaled, hermitian=True) @ (b / length) / length
    return beta, max(yy - float(beta @ b), 0.0)


def aic(rss: float, n: int, k: int) -> float:
    return n * float(np.log(max(rss, 1e-300) / n)) + 2 * k


def product_squares(gram: np.ndarray, size: int, products: list[tuple[int, int, float]]) -> tuple[np.ndarray, float]:
    """Least squares of column 0 where some coefficients are products of others.

    Columns 1 to ``size`` have free coefficients; each column after them has ``sign * beta[i] * beta[j]`` for its
    entry (i, j, sign) in ``products``. Gauss-Newton steps on the products of the columns, halved until the residual
    sum falls; without products this is one linear solve.
    """
    beta, rss = least_squares(gram[:size + 1, :size + 1], list(range(1, size + 1)))
    if not products:
        return beta, rss
    yy, cross, inner = float(gram[0, 0]), gram[1:, 0], gram[1:, 1:]

    def whole(b: np.ndarray) -> np.ndarray:
        return np.concatenate([b, [s * b[i] * b[j] for i, j, s in products]])

    def residual(b: np.ndarray) -> float:
        w = whole(b)
        return yy - 2 * float(w @ cross) + float(w @ inner @ w)

    best = residual(beta)
    for _ in range(100):
        slope = np.zeros((len(cross), size))
        slope[:size, :size] = np.eye(size)
        for row, (i, j, s) in enumerate(products, size):
            slope[row, i] += s * beta[j]
            slope[row, j] += s * beta[i]
        step = np.linalg.lstsq(slope.T @ inner @ slope, slope.T @ (cross - inner @ whole(beta)), rcond=None)[0]
        scale = 1.0
        while scale > 1e-6 and residual(beta + scale * step) > best:
            scale /= 2
        if scale <= 1e-6:
            break
        beta = beta + scale * step
        before, best = best, residual(beta)
        if before - best <= 1e-13 * yy:
            break
    return beta, max(best, 0.0)
