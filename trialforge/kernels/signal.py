"""Filters, robust fits and interpolation for whole recordings, in numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


def lowpass_sections(order: int, cutoff: float, fs: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Butterworth low-pass as first- and second-order sections (b, a), by the bilinear transform with prewarping."""
    if not 0 < cutoff < fs / 2:
        raise ValueError("the cutoff must lie between 0 and half the sampling frequency")
    w = np.tan(np.pi * cutoff / fs)
    out = []
    for k in range(order // 2):
        q = 2 * np.sin(np.pi * (2 * k + 1) / (2 * order))
        a0 = 1 + q * w + w * w
        out.append((np.array([w * w, 2 * w * w, w * w]) / a0, np.array([1.0, 2 * (w * w - 1) / a0, (1 - q * w + w * w) / a0])))
    if order % 2:
        out.append((np.array([w, w, 0.0]) / (1 + w), np.array([1.0, (w - 1) / (1 + w), 0.0])))
    return out


@lru_cache(maxsize=64)
def _block(b: tuple[float, ...], a: tuple[float, ...], size: int) -> tuple[np.ndarray, ...]:
    """Of a block of samples: its response to its own inputs, what a state adds to its outputs, what its inputs leave in the state, and the state's passage through it."""
    step = np.array([[-a[1], 1.0], [-a[2], 0.0]])
    feed = np.array([b[1] - a[1] * b[0], b[2] - a[2] * b[0]])
    powers = [np.eye(2)]
    for _ in range(size):
        powers.append(step @ powers[-1])
    inner = np.concatenate([[b[0]], [p[0] @ feed for p in powers[: size - 1]]])
    lag = np.arange(size)[:, None] - np.arange(size)[None, :]
    response = np.where(lag >= 0, inner[np.maximum(lag, 0)], 0.0)
    return response.T, np.array([p[0] for p in powers[:size]]).T, np.array([p @ feed for p in powers[:size][::-1]]), powers[size]


def _section(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """One section, started in the steady state of its first value.

    Blocks of samples are filtered at once; only the section's two states pass
    from block to block.
    """
    n = len(x)
    size = 32 if n <= 1024 else 256
    response, shown, left, passage = _block(tuple(b.tolist()), tuple(a.tolist()), size)
    rows = np.pad(x, (0, -n % size)).reshape(-1, size)
    z2 = (b[2] - a[2] * b.sum() / a.sum()) * x[0]
    state = np.array([(b[1] - a[1] * b.sum() / a.sum()) * x[0] + z2, z2])
    added, states = rows @ left, np.empty((len(rows), 2))
    for k in range(len(rows)):
        states[k] = state
        state = passage @ state + added[k]
    return (rows @ response + states @ shown).ravel()[:n]


def lowpass(x: np.ndarray, fs: float, cutoff: float | None = 3.0, order: int = 4) -> np.ndarray:
    """Zero-phase low-pass: forwards and backwards over an odd extension; no cutoff leaves the signal."""
    if cutoff is None:
        return x
    sections = lowpass_sections(order, cutoff, fs)
    pad = min(3 * (2 * len(sections) + 1), len(x) - 1)
    y = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]) if pad else x
    for _ in range(2):
        for b, a in sections:
            y = _section(b, a, y)
        y = y[::-1]
    return y[pad : len(y) - pad] if pad else y


def irls(y: np.ndarray, x: np.ndarray, c: float = 3.0, maxiter: int = 1000, intercept: bool = True, tol: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
    """Robust line by Tukey's biweight; the scale is the MAD of the residuals at each step.  Fitted values and (intercept, slope)."""
    design = np.column_stack([np.ones_like(x), x]) if intercept else x[:, None]
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    for _ in range(maxiter):
        r = y - design @ beta
        scale = np.median(np.abs(r - (0 if not intercept else np.median(r)))) / 0.6744897501960817
        if scale == 0:
            break
        u = r / (c * scale)
        w = np.where(np.abs(u) < 1, (1 - u * u) ** 2, 0)
        s = np.sqrt(w)
        new = np.linalg.lstsq(design * s[:, None], y * s, rcond=None)[0]
        if np.max(np.abs(new - beta)) < tol:
            beta = new
            break
        beta = new
    return design @ beta, beta if intercept else np.array([0.0, beta[0]])


def pchip(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Monotone cubic interpolation (Fritsch-Carlson slopes)."""
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    if len(x) == 2:
        return y[0] + d[0] * (at - x[0])
    m = np.zeros(len(x))
    w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
    same = np.sign(d[1:]) * np.sign(d[:-1]) > 0
    with np.errstate(divide="ignore", invalid="ignore"):
        m[1:-1] = np.where(same, (w1 + w2) / (w1 / d[:-1] + w2 / d[1:]), 0)

    def end(h0, h1, d0, d1):
        s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        if np.sign(s) != np.sign(d0):
            return 0.0
        return 3 * d0 if np.sign(d0) != np.sign(d1) and abs(s) > 3 * abs(d0) else s

    m[0], m[-1] = end(h[0], h[1], d[0], d[1]), end(h[-1], h[-2], d[-1], d[-2])
    i = np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(x) - 2)
    t = (at - x[i]) / h[i]
    return (1 + 2 * t) * (1 - t) ** 2 * y[i] + t * (1 - t) ** 2 * h[i] * m[i] + t * t * (3 - 2 * t) * y[i + 1] + t * t * (t - 1) * h[i] * m[i + 1]


def fill(signal: np.ndarray, time: np.ndarray, start: int, stop: int, left: int, right: int) -> np.ndarray:
    """The signal with [start, stop) replaced by a monotone cubic through the samples around it."""
    anchors = np.r_[max(0, start - left) : start, stop : min(len(signal), stop + right)]
    if len(anchors) < 2:
        return signal
    out = signal.copy()
    out[start:stop] = pchip(time[anchors], signal[anchors], time[start:stop])
    return out
