"""Solving one model's small normal equations, and the distributions its tests need."""

from __future__ import annotations

import math

import numpy as np

RANK_TOLERANCE = 1e-9


def sweep(matrix: np.ndarray, scale: np.ndarray, order: range) -> tuple[np.ndarray, np.ndarray]:
    """Gauss-Jordan sweep of the columns in ``order``.

    A column that earlier ones explain (what is left of it is below the tolerance of its
    own size) is left out. Returns the swept matrix and the mask of columns kept.
    """
    a = matrix / np.outer(scale, scale)
    kept = np.zeros(len(scale), dtype=bool)
    for c in order:
        pivot = a[c, c]
        if not pivot > RANK_TOLERANCE:
            continue
        kept[c] = True
        row = a[c] / pivot
        column = a[:, c].copy()
        a -= np.outer(column, row)
        a[c] = row
        a[:, c] = -column / pivot
        a[c, c] = 1.0 / pivot
    return a, kept


def least_squares(raw: np.ndarray, explained: np.ndarray | None, first: np.ndarray | None, levels: float) -> dict:
    """Coefficients, classical errors, N, R2 and model degrees of freedom from cross products.

    Index 0 is the constant and the last one the outcome. With absorbed levels the
    constant is that of their first level.
    """
    width = len(raw)
    y = width - 1
    scale = np.sqrt(np.where(np.diag(raw) > 0, np.diag(raw), 1.0))
    absorbed = explained is not None
    swept, kept = sweep(raw - explained if absorbed else raw, scale, range(1 if absorbed else 0, y))
    coef = np.where(kept, swept[:, y] * scale[y] / scale, np.nan)
    n = raw[0, 0]
    total = raw[y, y] - raw[0, y] ** 2 / n
    rss = max(swept[y, y] * scale[y] ** 2, 0.0)
    df_m = int(kept[1:y].sum() + (levels - 1 if absorbed else 0))
    df_r = n - df_m - 1
    spread = np.where(kept, np.diag(swept) / scale**2, np.nan)
    stderr = np.sqrt(spread * rss / df_r) if df_r > 0 else np.full(width, np.nan)
    if absorbed:
        coef[0] = np.nan
        if first is not None:
            slopes = np.where(kept[1:y], coef[1:y], 0.0)
            coef[0] = (first[y] - slopes @ first[1:y]) / first[0]
    return {
        "coef": coef[:y],
        "stderr": stderr[:y],
        "N": float(n),
        "r2": 1.0 - rss / total if total > 0 else math.nan,
        "df_m": float(df_m),
        "df_r": float(df_r),
    }


def normal_p(z: float) -> float:
    """Two-sided."""
    return math.erfc(abs(z) / math.sqrt(2.0))


def student_p(t: float, df: float) -> float:
    """Two-sided, by the continued fraction of the incomplete beta function."""
    if not (df > 0) or math.isnan(t):
        return math.nan
    x = df / (df + t * t)
    a, b = df / 2.0, 0.5
    if x <= 0.0 or x >= 1.0:
        return min(max(x, 0.0), 1.0)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _fraction(a, b, x) / a
    return 1.0 - front * _fraction(b, a, 1.0 - x) / b


def _fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 400):
        for term in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + term * d
            c = 1.0 + term / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return value
