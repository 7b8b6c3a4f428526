"""Whole recordings from raw traces to processed signal, and recordings from samples to trials."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import fitting, signal
from .recording import EPS32
from .relational import nearest
from .windowing import alignments, annotate, centred, extract_trials

FITS = ("OLS", "IRLS", "OLS_no_intercept", "IRLS_no_intercept", "bleaching")
CORRECTIONS = ("dF", "dF/F", "dB", "dB/B", "none")


def fit_reference(y: np.ndarray, x: np.ndarray | None, t: np.ndarray, fs: float, how: str | Callable, c: float, maxiter: int, window: float) -> np.ndarray:
    if callable(how):
        return how(y, x)[0]
    if how == "bleaching":
        return fitting.bleaching_fit(y, t, max(1, int(window * fs)))[0]
    intercept = not how.endswith("_no_intercept")
    if how.startswith("IRLS"):
        return signal.irls(y, x, c, maxiter, intercept)[0]
    design = np.column_stack([np.ones_like(x), x]) if intercept else x[:, None]
    return design @ np.linalg.lstsq(design, y, rcond=None)[0]


def preprocess(samples: DataFrame, key: str, t: str, raw: str, reference: str | None = None, cutoff: float | None = 3.0, order: int = 4, fit: str | Callable | None = None, correction: str | Callable = "dF/F", normalisation: str | Callable = "none", c: float = 3.0, maxiter: int = 1000, bleaching_window: float = 5.0) -> DataFrame:
    """Low-pass, reference fit, correction and normalisation of each recording in one grouped map.

    Filters and robust fits are sequential along a recording, so a recording is
    the unit of work; recordings spread over the cluster.  Without a reference
    the fit is a bleaching curve.  Returns ``key, t, filtered, fitted_ref,
    processed``; a recording of fewer than two samples passes unfiltered, one
    sampled too slowly for the cutoff is an error.
    """
    fit = fit or ("IRLS" if reference else "bleaching")
    if not callable(fit) and fit not in FITS:
        raise ValueError(f"unknown fit {fit}")
    if not callable(correction) and correction not in CORRECTIONS:
        raise ValueError(f"unknown correction {correction}")
    if not callable(normalisation) and normalisation not in ("zscore", "nullZ", "none"):
        raise ValueError(f"unknown normalisation {normalisation}")
    if reference is None and fit != "bleaching" and not callable(fit):
        raise ValueError("a single channel takes the bleaching fit")

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(t)
        time, y = p[t].to_numpy(float), p[raw].to_numpy(float)
        x = p[reference].to_numpy(float) if reference else None
        fs = (len(time) - 1) / (time[-1] - time[0]) if len(time) > 1 and time[-1] > time[0] else 0.0
        if cutoff is not None and len(y) > 1:
            if fs <= 2 * cutoff:
                raise ValueError(f"recording {p[key].iloc[0]}: a cutoff of {cutoff} Hz needs more than {2 * cutoff} samples a second, not {fs}")
            y = signal.lowpass(y, fs, cutoff, order)
            x = signal.lowpass(x, fs, cutoff, order) if reference else None
        ref = fit_reference(y, x, time, fs, fit, c, maxiter, bleaching_window) if len(y) > 1 else y
        if callable(correction):
            out = correction(y, ref)
        else:
            out = y if correction == "none" else (y - ref) / (np.maximum(ref, EPS32) if "/" in correction else 1)
        if callable(normalisation):
            out = normalisation(out)
        elif normalisation != "none":
            with np.errstate(divide="ignore", invalid="ignore"):
                out = (out - (out.mean() if normalisation == "zscore" else 0)) / out.std()
        return pd.DataFrame({key: p[key], t: time, "filtered": y, "fitted_ref": ref, "processed": out})

    cols = [key, t, raw] + ([reference] if reference else [])
    schema = f"`{key}` {samples.schema[key].dataType.simpleString()}, `{t}` double, filtered double, fitted_ref double, processed double"
    return samples.select(*cols).groupBy(key).applyInPandas(run, schema)


def grid(low: float, high: float, freq: float) -> tuple[int, int]:
    """Index bounds [first, last) of a window around the centre's sample; halves round to even."""
    n, first = round((high - low) * freq), round(low * freq)
    if n < 1:
        raise ValueError("the window holds no sample")
    return first, first + n


def trials_of(samples: DataFrame, events: DataFrame, align_to: list[str], bounds: tuple[float, float], freq: float, center_on: list[str] | None = None, baseline: tuple[float, float] | None = None, tolerances: dict[str, tuple[float, float]] | None = None, normalisation: str = "none", rule: str = "first", key: str = "user_id", value: str = "value") -> DataFrame:
    """Event-aligned trials in long form, from one plan: alignment, annotation, centring, snapping, windows, normalisation.

    The baseline window is centred on the alignment event, the trial on the
    centre; a trial whose trial or baseline window leaves the recording goes.
    Normalisation (``none``, ``zero``, ``zscore``) uses the baseline, else the
    trial itself.  Returns ``key, trial_ord, align_event, align_t, center_t,
    time_idx, time, signal``.
    """
    if normalisation not in ("none", "zero", "zscore"):
        raise ValueError(f"unknown normalisation {normalisation}")
    out = alignments(events, align_to, key)
    if center_on:
        near = {c: (tolerances or {}).get(c, bounds) for c in center_on}
        out = centred(out, annotate(out, events, near, key, rule=rule), center_on, key)
    else:
        out = out.withColumn("center_t", F.col("align_t"))
    out = out.select(key, "trial_ord", "align_event", "align_t", "center_t")
    s = samples.select(key, "idx", "t", value)
    at = nearest(out, s, key, "center_t", "t", "idx").withColumnRenamed("near_id", "center_idx").drop("near")
    first, last = grid(*bounds, freq)
    long = extract_trials(s, at, (first, last), key, "idx", value).drop("center_idx")
    long = long.withColumn("time", (F.col("time_idx") + first) / F.lit(float(freq)))
    by = [key, "trial_ord"]
    if baseline is None and normalisation == "none":
        return long
    if baseline is None:
        stats = long
    else:
        snapped = nearest(out, s, key, "align_t", "t", "idx").withColumnRenamed("near_id", "center_idx").select(*by, "center_idx")
        stats = extract_trials(s, snapped, grid(*baseline, freq), key, "idx", value)
    stats = stats.groupBy(*by).agg(F.avg("signal").alias("_m"), F.stddev_pop("signal").alias("_s"))
    joined = long.join(stats, by)
    if normalisation != "none":
        scale = F.when(F.col("_s") == 0, F.lit(2.220446049250313e-16)).otherwise(F.col("_s")) if normalisation == "zscore" else F.lit(1.0)
        joined = joined.withColumn("signal", (F.col("signal") - F.col("_m")) / scale)
    return joined.drop("_m", "_s")
