"""Linear models at every time point of trials, fixed effects with an optional random intercept per subject.

Rows are reduced map-side to sums per time point (and subject); the models are
solved from those, so the data of a point are never held together.  The result
is long: ``time_idx, term, beta, se, lower, upper, n, sigma, tau, aic``.  This is
the point-wise stage of a functional mixed model; coefficients are not smoothed
over time afterwards and intervals are point-wise.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..kernels import special

SCHEMA = "time_idx int, term string, beta double, se double, lower double, upper double, n long, sigma double, tau double, aic double"


def profile(n: np.ndarray, sx: np.ndarray, sy: np.ndarray, xx: np.ndarray, xy: np.ndarray, yy: float, ratio: float) -> tuple[float, np.ndarray, np.ndarray, float]:
    """Restricted log-likelihood at a variance ratio, coefficients, inverse information and residual sum; sums are per subject (n, sx, sy) and over all (xx, xy, yy)."""
    c = ratio / (1 + n * ratio)
    a = xx - (sx * c[:, None]).T @ sx
    b = xy - sx.T @ (c * sy)
    q = yy - float((c * sy * sy).sum())
    inverse = np.linalg.pinv(a)
    beta = inverse @ b
    rss = max(q - float(beta @ b), 1e-300)
    free = n.sum() - len(beta)
    _, det = np.linalg.slogdet(a)
    return -0.5 * (free * np.log(rss / free) + np.log1p(n * ratio).sum() + det), beta, inverse, rss


def solve(time: int, names: list[str], n: np.ndarray, sx: np.ndarray, sy: np.ndarray, xx: np.ndarray, xy: np.ndarray, yy: float, mixed: bool, level: float = 0.95) -> list[tuple]:
    """One time point: the ratio by golden-section search of its logarithm, with none among the candidates."""
    total, k = int(n.sum()), len(names)
    if total <= k:
        return [(time, name, None, None, None, None, total, None, None, None) for name in names]
    best = 0.0
    if mixed and len(n) > 1:
        f = lambda z: profile(n, sx, sy, xx, xy, yy, np.exp(z))[0]
        grid = np.linspace(-12, 8, 41)
        at = int(np.argmax([f(z) for z in grid]))
        low, high = grid[max(at - 1, 0)], grid[min(at + 1, len(grid) - 1)]
        golden = (np.sqrt(5) - 1) / 2
        for _ in range(60):
            x, y = high - golden * (high - low), low + golden * (high - low)
            low, high = (low, y) if f(x) >= f(y) else (x, high)
        z = (low + high) / 2
        best = float(np.exp(z)) if f(z) > profile(n, sx, sy, xx, xy, yy, 0.0)[0] else 0.0
    ll, beta, inverse, rss = profile(n, sx, sy, xx, xy, yy, best)
    variance = rss / (total - k)
    se = np.sqrt(np.maximum(np.diag(inverse) * variance, 0))
    t = special.t_critical(1 - level, total - k)
    aic = -2 * (ll - 0.5 * (total - k) * (1 + np.log(2 * np.pi))) + 2 * (k + 1 + bool(mixed))
    return [(time, name, float(b), float(s), float(b - t * s), float(b + t * s), total, float(np.sqrt(variance)), float(np.sqrt(variance * best)), float(aic)) for name, b, s in zip(names, beta, se, strict=True)]


def fit(long: DataFrame, terms: dict[str, Column], signal: str = "signal", time: str = "time_idx", subject: str | None = None, level: float = 0.95) -> DataFrame:
    """Models ``signal ~ 1 + terms (+ 1 | subject)`` of trials in long form; rows with a missing value go.

    A term is a numeric column; a factor is a term per level but one, as ``dummies`` makes them.
    """
    names = ["(Intercept)", *terms]
    own = long.select(F.col(time).cast("int").alias("time_idx"), F.col(signal).cast("double").alias("_y"), (F.col(subject).cast("string") if subject else F.lit("")).alias("_s"), F.lit(1.0).alias("_x0"), *[c.cast("double").alias(f"_x{k}") for k, c in enumerate(terms.values(), 1)])
    own = own.dropna()
    k = len(names)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = own.groupBy("time_idx", "_s").agg(
        F.count("*").alias("n"), F.sum("_y").alias("sy"), F.sum(F.col("_y") * F.col("_y")).alias("yy"), F.array(*[F.sum(f"_x{i}") for i in range(k)]).alias("sx"),
        F.array(*[F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")) for i, j in pairs]).alias("xx"), F.array(*[F.sum(F.col(f"_x{i}") * F.col("_y")) for i in range(k)]).alias("xy"),
    )
    mixed = subject is not None

    def run(p: pd.DataFrame) -> pd.DataFrame:
        flat = np.sum(np.stack(p["xx"].to_list()), axis=0)
        xx = np.zeros((k, k))
        for v, (i, j) in zip(flat, pairs, strict=True):
            xx[i, j] = xx[j, i] = v
        rows = solve(int(p["time_idx"].iloc[0]), names, p["n"].to_numpy(float), np.stack(p["sx"].to_list()), p["sy"].to_numpy(float), xx, np.sum(np.stack(p["xy"].to_list()), axis=0), float(p["yy"].sum()), mixed, level)
        return pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    # a row per subject and point is what a group holds
    return sums.groupBy("time_idx").applyInPandas(run, SCHEMA)


def dummies(frame: DataFrame, column: str, reference: object = None, limit: int = 1000) -> dict[str, Column]:
    """A term per level of a factor but the reference (the first level if none is given); more than ``limit`` levels are an error."""
    levels = [r[0] for r in frame.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column).limit(limit + 1).collect()]
    if len(levels) > limit:
        raise ValueError(f"more than {limit} levels")
    reference = levels[0] if reference is None and levels else reference
    if reference not in levels:
        raise KeyError(reference)
    return {f"{column}{v}": (F.col(column) == F.lit(v)).cast("double") for v in levels if v != reference}


#: Columns of a result by the name that a long export gives them.
STATISTICS = {"value": "beta", "lower": "lower", "upper": "upper"}


def terms_of(result: DataFrame) -> list[str]:
    return sorted(r[0] for r in result.select("term").distinct().collect())  # the model's terms


def term(result: DataFrame, name: str) -> DataFrame:
    out = result.where(F.col("term") == name)
    if not out.limit(1).count():
        raise KeyError(name)
    return out


def statistic(result: DataFrame, name: str) -> DataFrame:
    """One statistic of all terms."""
    if name not in result.columns:
        raise KeyError(name)
    return result.select("time_idx", "term", name)


def aic(result: DataFrame) -> DataFrame:
    return result.groupBy("time_idx").agg(F.first("aic").alias("aic"))


def to_long(result: DataFrame, axis: DataFrame | None = None, only: list[str] | None = None, names: dict[str, str] | None = None, rename: Callable[[str], str] | None = None) -> DataFrame:
    """``time_idx, time, term`` and the chosen statistics; times of a table ``time_idx, time`` where one is given, null for points that it lacks."""
    names = STATISTICS if names is None else names
    out = result if only is None else result.where(F.col("term").isin(only))
    out = out.join(F.broadcast(axis), "time_idx", "left") if axis is not None else out.withColumn("time", F.lit(None).cast("double"))  # one short axis
    return out.select("time_idx", "time", "term", *[F.col(c).alias(rename(n) if rename else n) for n, c in names.items() if c in result.columns])
