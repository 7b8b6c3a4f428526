"""Tail probabilities of the t and F distributions by the regularised incomplete beta function."""

from __future__ import annotations

import math

import numpy as np


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (Lentz)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            step = 1.0
        elif i % 2 == 0:
            step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            step = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + step * d or tiny)
        c = 1 + step / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-14 and i:
            break
    return front * (f - 1)


def t_two_sided(t: float | None, df: float | None) -> float | None:
    if t is None or df is None or math.isnan(t) or math.isnan(df):
        return None
    return betainc(df / 2, 0.5, df / (df + t * t))


def f_upper(f: float, df1: float, df2: float) -> float:
    return betainc(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))


def t_critical(p: float, df: float) -> float:
    """t with two-sided tail p, by bisection."""
    low, high = 0.0, 1.0
    while t_two_sided(high, df) > p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_two_sided(mid, df) > p else (low, mid)
    return (low + high) / 2


def betainc_all(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """``betainc`` of arrays: every element takes each step of the continued fraction at once."""
    a, b, x = (np.array(v, float) for v in np.broadcast_arrays(a, b, x))
    turn = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, 1 - x, x)
    inside = (x > 0) & (x < 1) & (a > 0) & (b > 0)
    z = np.where(inside, x, 0.5)
    a, b = np.where(inside, a, 1.0), np.where(inside, b, 1.0)
    # log gamma of the few distinct parameters
    kinds, which = np.unique(np.concatenate([a, b, a + b]), return_inverse=True)
    la, lb, lab = np.split(np.array([math.lgamma(v) for v in kinds.tolist()])[which], 3)
    front = np.exp(lab - la - lb + a * np.log(z) + b * np.log1p(-z)) / a
    tiny, f, c, d = 1e-300, np.ones_like(z), np.ones_like(z), np.zeros_like(z)
    for i in range(400):
        m = i // 2
        step = 1.0 if i == 0 else m * (b - m) * z / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * z / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 + step * d
        d = 1 / np.where(d == 0, tiny, d)
        c = 1 + step / c
        c = np.where(c == 0, tiny, c)
        f = f * c * d
        if i and (np.abs(1 - c * d) < 1e-14).all():
            break
    out = np.where(inside, front * (f - 1), np.where(x >= 1, 1.0, 0.0))
    return np.where(turn, 1 - out, out)


def t_two_sided_all(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided p of arrays; NaN where either is missing."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    ok = ~(np.isnan(t) | np.isnan(df))
    safe_t, safe_df = np.where(ok, t, 0.0), np.where(ok, df, 1.0)
    return np.where(ok, betainc_all(safe_df / 2, np.full_like(safe_df, 0.5), safe_df / (safe_df + safe_t * safe_t)), np.nan)


def f_upper_all(f: np.ndarray, df1: np.ndarray, df2: np.ndarray) -> np.ndarray:
    """Upper tail of F of arrays; NaN where one is missing."""
    f, df1, df2 = (np.asarray(v, float) for v in (f, df1, df2))
    ok = ~(np.isnan(f) | np.isnan(df1) | np.isnan(df2))
    f, df1, df2 = np.where(ok, f, 1.0), np.where(ok, df1, 1.0), np.where(ok, df2, 1.0)
    return np.where(ok, betainc_all(df2 / 2, df1 / 2, df2 / (df2 + df1 * f)), np.nan)
