"""Resampling, robust smoothing and bleaching fits for whole recordings, in numpy."""

from __future__ import annotations

import math

import numpy as np


def resample(x: np.ndarray, down: int, up: int = 1, beta: float = 5.0, line: bool = True) -> np.ndarray:
    """Rate change by up / down through a Kaiser-windowed FIR low-pass; ceil(n up / down) values.

    With ``line``, that through the end points is taken off before filtering and
    put back afterwards, so the ends do not fall towards zero; without it they
    do.
    """
    if up < 1 or down < 1:
        raise ValueError("factors must be at least 1")
    g = math.gcd(up, down)
    up, down = up // g, down // g
    n = len(x)
    if n == 0 or up == down:
        return np.asarray(x, float)
    rate = max(up, down)
    half = 10 * rate
    k = np.arange(-half, half + 1)
    taps = np.sinc(k / rate) * np.kaiser(2 * half + 1, beta)
    taps *= up / taps.sum()
    slope = (x[-1] - x[0]) / (n - 1) if n > 1 else 0.0
    stuffed = np.zeros((n - 1) * up + 1)
    start = x[0] if line else 0.0
    slope = slope if line else 0.0
    stuffed[::up] = x - (start + slope * np.arange(n))
    out = -(-n * up // down)
    at = np.arange(out) * down
    y = np.convolve(stuffed, taps)[half:]
    y = np.pad(y, (0, max(0, at[-1] + 1 - len(y))))[at]
    return y + start + slope * at / up


def resample_time(t: np.ndarray, down: int, up: int = 1) -> np.ndarray:
    """Times of the resampled values; the spacing must be regular."""
    step = np.diff(t)
    if len(step) == 0 or not np.allclose(step, step[0], rtol=1e-5):
        raise ValueError("the sampling must be regular")
    return t[0] + np.arange(-(-len(t) * up // down)) * step[0] * down / up


def mirrored_windows(x: np.ndarray, width: int) -> np.ndarray:
    """One centred window per sample, over an edge-repeating mirror of the signal."""
    left = width // 2
    return np.lib.stride_tricks.sliding_window_view(np.pad(x, (left, width - left - 1), mode="symmetric"), width)


def lowess(y: np.ndarray, x: np.ndarray, frac: float = 0.05, rounds: int = 3) -> np.ndarray:
    """Locally weighted lines (tricube), made robust by bisquare weights of the residuals."""
    n = len(x)
    k = min(n, max(2, int(frac * n + 1e-10)))
    start = np.zeros(n, int)
    a = 0
    for i in range(n):
        while a + k < n and x[i] - x[a] > x[a + k] - x[i]:
            a += 1
        start[i] = a
    near = start[:, None] + np.arange(k)
    dist = np.abs(x[near] - x[:, None])
    reach = np.maximum(dist.max(axis=1, keepdims=True), 1e-300)
    tricube = np.clip(1 - (dist / reach) ** 3, 0, None) ** 3
    robust, fit = np.ones(n), y.astype(float)
    for _ in range(rounds + 1):
        w = tricube * robust[near]
        total = w.sum(axis=1)
        ok = total > 0
        safe = np.where(ok, total, 1)
        mx, my = (w * x[near]).sum(axis=1) / safe, (w * y[near]).sum(axis=1) / safe
        dx = x[near] - mx[:, None]
        var = (w * dx * dx).sum(axis=1)
        slope = np.where(var > 1e-12 * reach[:, 0] ** 2, (w * dx * y[near]).sum(axis=1) / np.where(var > 0, var, 1), 0)
        if not ok.any():
            break
        # a point whose whole neighbourhood was ruled out lies between its nearest fitted ones
        fit = np.interp(x, x[ok], (my + slope * (x - mx))[ok])
        r = np.abs(y - fit)
        s = np.median(r)
        if s == 0:
            break
        robust = np.clip(1 - (r / (6 * s)) ** 2, 0, None) ** 2
    return fit


def bi_exponential(t: np.ndarray, a1: float, b1: float, a2: float, b2: float, c: float) -> np.ndarray:
    return a1 * np.exp(-b1 * t) + a2 * np.exp(-b2 * t) + c


def neg_exponential(t: np.ndarray, a: float, b: float, c: float) -> np.ndarray:
    return a * np.exp(-b * t) + c


def strided_medians(x: np.ndarray, window: int, stride: int) -> np.ndarray:
    return np.median(np.lib.stride_tricks.sliding_window_view(x, window)[::stride], axis=1)


def bleaching_fit(signal: np.ndarray, time: np.ndarray, window: int, stride: int | None = None, maxiter: int = 400) -> tuple[np.ndarray, np.ndarray, float]:
    """Decay a1 exp(-b1 t) + a2 exp(-b2 t) + c of a recording: fitted values, parameters, r squared.

    Medians of strided windows stand for the signal; residuals are scaled by
    their deviation from a robust smooth and weighed as soft L1.  Amplitudes and
    rates stay non-negative through projected Levenberg-Marquardt steps.
    """
    window = max(1, min(window, len(signal)))
    stride = stride or max(1, window // 2)
    y, t = strided_medians(signal, window, stride), strided_medians(time - time[0], window, stride)
    rough = y - lowess(y, t) if len(y) > 4 else y - y.mean()
    scale = 1.4826 * np.median(np.abs(rough - np.median(rough)))
    scale = scale if scale > 0 else max(float(np.std(rough)), 1e-6 * max(float(np.ptp(y)), float(np.abs(y).max()), 1.0))
    span, drop = max(float(t[-1]), 1e-9), max(float(y[0] - y.min()), 1e-9)
    low, high = np.array([0, 1e-9, 0, 1e-9, -np.inf]), np.array([np.inf, 1e3 / span, np.inf, 1e3 / span, np.inf])

    def cost(p: np.ndarray) -> float:
        z = ((y - bi_exponential(t, *p)) / scale) ** 2
        return float((2 * (np.sqrt(1 + z) - 1)).sum())

    best, least = None, np.inf
    for fast, slow in ((10.0, 1.0), (30.0, 0.5), (4.0, 0.1)):
        p = np.array([drop / 2, fast / span, drop / 2, slow / span, float(y.min())])
        now, damp = cost(p), 1e-3
        for _ in range(maxiter):
            e1, e2 = np.exp(-p[1] * t), np.exp(-p[3] * t)
            jac = np.column_stack([e1, -p[0] * t * e1, e2, -p[2] * t * e2, np.ones_like(t)]) / scale
            r = (y - bi_exponential(t, *p)) / scale
            w = 1 / np.sqrt(1 + r * r)
            h, g = jac.T @ (jac * w[:, None]), jac.T @ (w * r)
            new = np.clip(p + np.linalg.lstsq(h + damp * np.diag(np.diag(h) + 1e-12), g, rcond=None)[0], low, high)
            value = cost(new)
            if value < now:
                gain, p, now, damp = now - value, new, value, max(damp / 3, 1e-12)
                if gain < 1e-12 * (1 + now):
                    break
            else:
                damp *= 4
                if damp > 1e12:
                    break
        if now < least:
            best, least = p, now
    fit = bi_exponential(time - time[0], *best)
    sst = float(((signal - signal.mean()) ** 2).sum())
    return fit, best, 1 - float(((signal - fit) ** 2).sum()) / sst if sst else float("nan")
