"""Seeded simulated recordings: bleaching, events, dynamics, movement, artifacts and noise, and libraries of them.

A recording is sequential (its draws come from one generator in a fixed order),
so it is the unit of work; a library spreads its recordings over the cluster,
one task group per parameter row.
"""

from __future__ import annotations

import inspect
import itertools
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import fitting, signal

# The defaults of a recording.
BLEACHING = {"alpha1": 50, "alpha2": 20, "tau1": 300, "tau2": 10000, "B_floor": 10}


def smootherstep(x: np.ndarray) -> np.ndarray:
    x = np.clip(x, 0, 1)
    return x**3 * (x * (x * 6 - 15) + 10)


def gamma(t, amplitude=1.0, shape_k=3.0, tau_sec=1.0):
    return np.where(t >= 0, amplitude * (np.maximum(t, 0) / ((shape_k - 1) * tau_sec)) ** (shape_k - 1) * np.exp((shape_k - 1) - t / tau_sec), 0.0)


def decay(t, amplitude=1.0, tau_sec=1.0):
    return np.where(t >= 0, amplitude * np.exp(-t / tau_sec), 0.0)


def alpha(t, amplitude=1.0, tau_sec=1.0):
    return np.where(t >= 0, amplitude * t / tau_sec * np.exp(1 - t / tau_sec), 0.0)


def sum_of_decays(t, amplitude=1.0, taus=(1.0, 5.0), weights=(0.5, 0.5)):
    """Weighted exponential decays, scaled to the amplitude at the onset."""
    total = sum(weights)
    return np.where(t >= 0, amplitude / total * sum(w * np.exp(-t / tau) for w, tau in zip(weights, taus, strict=True)), 0.0)


def domed_trapezoid(t, amplitude=1.0, rise=1.0, hold=2.0, fall=1.0, dome=0.2):
    """Smooth rise, a plateau that bulges by ``dome`` of the amplitude in its middle, and a smooth fall."""
    edge = np.where(t < rise, smootherstep(t / rise), smootherstep((rise + hold + fall - t) / fall))
    bulge = 1 + dome * np.sin(np.pi * np.clip((t - rise) / hold, 0, 1))
    return np.where((t >= 0) & (t <= rise + hold + fall), amplitude * edge * bulge, 0.0)


def taper_end(x: np.ndarray, n: int, shape: str = "hann") -> np.ndarray:
    """The last n values brought down to zero, by half a Hann window or a line."""
    if shape not in ("hann", "linear"):
        raise ValueError(f"unknown taper {shape}")
    n = min(n, len(x))
    out = np.array(x, float)
    if n:
        step = np.linspace(0, 1, n)
        out[len(x) - n :] *= 0.5 * (1 + np.cos(np.pi * step)) if shape == "hann" else 1 - step
    return out


KERNELS: dict[str, Callable] = {"gamma": gamma, "decay": decay, "alpha": alpha, "sum_of_decays": sum_of_decays, "domed_trapezoid": domed_trapezoid}


def time_axis(seconds: float, freq: float, start: float = 0.0) -> np.ndarray:
    if seconds <= 0 or freq <= 0:
        raise ValueError("the duration and the frequency must be positive")
    return np.arange(round(seconds * freq)) / freq + start


def evenly_spaced(time: np.ndarray, n: int | None, left: float | None = None, right: float | None = None) -> np.ndarray:
    """n samples of the axis at even steps of the index, from ``left`` seconds after its start to ``right`` before its end."""
    if not n:
        return np.empty(0)
    low = 0 if left is None else np.searchsorted(time, time[0] + left)
    high = len(time) - 1 if right is None else np.searchsorted(time, time[-1] - right)
    return time[np.linspace(low, high, n, dtype=int)]


@dataclass(frozen=True)
class Event:
    onsets: tuple[float, ...]
    amplitude: float = 1.0
    kernel: str | Callable = "gamma"
    options: dict = field(default_factory=dict)

    def response(self, freq: float, longest: float, cutoff: float = 1e-4) -> np.ndarray:
        """The kernel until it falls to ``cutoff`` of its peak, its last value zero; an error if it does not within ``longest`` seconds."""
        f = self.kernel if callable(self.kernel) else KERNELS[self.kernel]
        y = np.asarray(f(time_axis(longest, freq), self.amplitude, **self.options), float)
        size = np.abs(y)
        top = int(size.argmax())
        if size[top] == 0:
            return np.zeros(1)
        high = np.flatnonzero(size[top:] > cutoff * size[top])
        end = min(top + int(high[-1]) + 2, len(y))
        if end == len(y) and size[-1] > cutoff * size[top]:
            raise ValueError(f"the kernel does not decay within {longest} s")
        out = y[:end].copy()
        out[-1] = 0.0
        return out


@dataclass(frozen=True)
class Recording:
    """Parameters of a simulated recording; ``render`` draws it."""

    length_sec: float = 1000.0
    frequency: float = 100.0
    events: dict[str, Event] = field(default_factory=dict)
    bleaching: dict = field(default_factory=lambda: dict(BLEACHING))
    bleaching_iso: dict | None = None
    iso_scale: float | None = 0.8
    iso_offset: float | None = None
    photons: float | None = 1e5
    photons_iso: float | None = None
    gaussian: float | None = 0.2
    gaussian_iso: float | None = None
    dynamic_amplitude: float | None = None
    dynamic_center: float = 0.0
    dynamic_frequency: float = 1.0
    movement: float | None = 0.5
    movement_cutoff: float = 0.1
    spikes: int = 0
    spike_amplitudes: tuple[float, float] = (-0.5, -0.1)
    spike_decays: tuple[float, float] = (0.01, 0.05)
    jumps: int = 0
    jump_amplitudes: tuple[float, float] = (-0.5, 0.5)
    jump_durations: tuple[float, float] = (10.0, 100.0)
    leakage: float = 0.0
    longest_event: float = 1000.0
    seed: int | None = 42

    def __post_init__(self):
        if self.bleaching_iso is not None and (self.iso_scale is not None or self.iso_offset is not None):
            raise ValueError("give either a bleaching curve of the second channel or its scale and offset")
        if self.bleaching_iso is None and self.iso_scale is None and self.iso_offset is None:
            raise ValueError("the second channel needs a bleaching curve, a scale or an offset")
        for v in (self.photons, self.photons_iso, self.gaussian, self.gaussian_iso):
            if v is not None and v <= 0:
                raise ValueError("noise scales must be positive")
        if self.movement is not None and not 0 <= self.movement <= 1:
            raise ValueError("the attenuation must lie between 0 and 1")
        if self.spikes < 0 or self.jumps < 0:
            raise ValueError("artifacts cannot be fewer than none")

    @property
    def time(self) -> np.ndarray:
        return time_axis(self.length_sec, self.frequency)

    # -- events ----------------------------------------------------------------

    def with_event(self, label: str, onsets, amplitude: float = 1.0, kernel: str | Callable = "gamma", **options) -> Recording:
        return replace(self, events=self.events | {label: Event(tuple(float(o) for o in onsets), amplitude, kernel, options)})

    def without_event(self, label: str) -> Recording:
        if label not in self.events:
            raise KeyError(label)
        return replace(self, events={k: v for k, v in self.events.items() if k != label})

    def with_relative_events(self, anchor: str, offsets: tuple[float, float], labels: list[str], chance: float | None = None, weights: list[float] | None = None, amplitudes: list[float] | None = None, kernels: list | None = None, options: list[dict] | None = None, seed: int | None = None) -> Recording:
        """Events drawn after (or before) those of ``anchor``: whether, when and which, in that order of draws; what leaves the recording goes."""
        rng = np.random.default_rng(self.seed if seed is None else seed)
        at = np.array(self.events[anchor].onsets)
        occurs = rng.random(len(at)) < (1.0 if chance is None else chance)
        new = at[occurs] + rng.uniform(*offsets, size=int(occurs.sum()))
        names = rng.choice(labels, size=len(new), p=weights)
        inside = (new >= self.time[0]) & (new <= self.time[-1])
        out = self
        for k, label in enumerate(labels):
            out = out.with_event(label, new[inside & (names == label)], 1.0 if amplitudes is None else amplitudes[k], "gamma" if kernels is None else kernels[k], **({} if options is None else options[k]))
        return out

    # -- layers ----------------------------------------------------------------

    def _bleached(self, t: np.ndarray, p: dict, scale: float | None, offset: float | None) -> tuple[np.ndarray, float]:
        curve = p["alpha1"] * np.exp(-t / p["tau1"]) + p["alpha2"] * np.exp(-t / p["tau2"]) + p["B_floor"]
        return curve * (1.0 if scale is None else scale) + (offset or 0.0), p["B_floor"]

    def _responses(self, t: np.ndarray) -> np.ndarray:
        out = np.zeros(len(t))
        for label, e in self.events.items():
            onsets = np.array(e.onsets)
            if len(onsets) and (onsets.min() < t[0] or onsets.max() > t[-1]):
                raise ValueError(f"events of {label} lie outside the recording")
            y = e.response(self.frequency, self.longest_event)
            for o in np.searchsorted(t, onsets).tolist():
                out[o : o + len(y)] += y[: len(t) - o]
        return out

    def _dynamics(self, t: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        if self.dynamic_amplitude is None:
            return np.zeros(len(t))
        slow = rng.normal(self.dynamic_center, self.dynamic_amplitude, size=len(time_axis(t[-1] - t[0], self.dynamic_frequency)))
        ratio = Fraction(self.frequency / self.dynamic_frequency).limit_denominator(10_000)
        fast = fitting.resample(slow, ratio.denominator, ratio.numerator, line=False)[: len(t)]
        return np.pad(fast, (0, len(t) - len(fast)), mode="edge")

    def _movement(self, n: int, rng: np.random.Generator) -> np.ndarray:
        """Uniform noise below the cutoff, drawn with a margin of ten periods on either side."""
        if not self.movement:
            return np.ones(n)
        margin = int(np.ceil(10.0 / self.movement_cutoff * self.frequency))
        slow = signal.lowpass(rng.uniform(0.0, 1.0, size=n + 2 * margin), self.frequency, self.movement_cutoff, 4)
        return 1.0 - self.movement * slow[margin : margin + n]

    def _spikes(self, n: int, rng: np.random.Generator, cutoff: float = 1e-4) -> np.ndarray:
        out = np.ones(n)
        if self.spikes:
            longest = max(int(5 * max(self.spike_decays) * self.frequency), 3)
            at = rng.choice(np.arange(0, n - longest), size=self.spikes, replace=False)
            heights, taus = rng.uniform(*self.spike_amplitudes, size=self.spikes), rng.uniform(*self.spike_decays, size=self.spikes)
            for o, a, tau in zip(at.tolist(), heights, taus, strict=True):
                y = a * np.exp(-time_axis(-tau * np.log(cutoff / abs(a)), self.frequency) / tau)
                out[o : o + len(y)] += y[: n - o]
        return out

    def _jumps(self, n: int, rng: np.random.Generator) -> np.ndarray:
        out = np.ones(n)
        if self.jumps:
            low, high = (round(f(self.jump_durations) * self.frequency) for f in (min, max))
            at = rng.choice(np.arange(0, n - high), size=self.jumps, replace=False)
            heights, sizes = rng.uniform(*self.jump_amplitudes, size=self.jumps), rng.choice(np.arange(low, high), size=self.jumps, replace=True)
            for o, a, k in zip(at.tolist(), heights, sizes.tolist(), strict=True):
                out[o : o + k] += a
        return out

    @staticmethod
    def _noise(clean: np.ndarray, photons: float | None, sigma: float | None, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """Shot noise of the expected counts, and Gaussian noise (without a scale it is one throughout)."""
        shot = np.zeros(len(clean))
        if photons is not None:
            expected = np.round(clean * photons, 0)
            shot = (rng.poisson(expected) - expected) / photons
        return shot, np.ones(len(clean)) if sigma is None else rng.normal(0.0, sigma, size=len(clean))

    def render(self, seed: int | None = None) -> dict[str, np.ndarray]:
        """All layers and both channels.  Draws: dynamics, movement, spikes, jumps, then shot and Gaussian noise of the first and of the second channel."""
        rng, t = np.random.default_rng(self.seed if seed is None else seed), self.time
        base, floor = self._bleached(t, self.bleaching, None, None)
        iso, iso_floor = self._bleached(t, self.bleaching_iso or self.bleaching, None if self.bleaching_iso else self.iso_scale, None if self.bleaching_iso else self.iso_offset)
        events, dynamics = self._responses(t), self._dynamics(t, rng)
        neural = events + dynamics
        moves, spikes, jumps = self._movement(len(t), rng), self._spikes(len(t), rng), self._jumps(len(t), rng)
        artifacts = moves * spikes * jumps
        bright = ((base - floor) * neural + base) * artifacts
        bright_iso = ((iso - iso_floor) * self.leakage * neural + iso) * artifacts
        shot, gauss = self._noise(bright, self.photons, self.gaussian, rng)
        shot_iso, gauss_iso = self._noise(bright_iso, self.photons if self.photons_iso is None else self.photons_iso, self.gaussian if self.gaussian_iso is None else self.gaussian_iso, rng)
        return {
            "time": t, "events": events, "dynamic_noise": dynamics, "neural_trace": neural, "photobleaching": base, "movement_artifacts": moves, "spike_artifacts": spikes, "jump_artifacts": jumps, "artifacts": artifacts,
            "shot_noise": shot, "gaussian_noise": gauss, "noise": shot + gauss, "full_signal": bright + shot + gauss,
            "iso_events": self.leakage * events, "iso_dynamic_noise": self.leakage * dynamics, "iso_neural_trace": self.leakage * neural, "iso_photobleaching": iso,
            "iso_shot_noise": shot_iso, "iso_gaussian_noise": gauss_iso, "iso_noise": shot_iso + gauss_iso, "iso_full_signal": bright_iso + shot_iso + gauss_iso,
        }


_SHARED = ("artifacts", "movement_artifacts", "spike_artifacts", "jump_artifacts")
_CONDENSED = ("neural_trace", "photobleaching", "artifacts", "noise", "full_signal")
_FULL = ("events", "dynamic_noise", "photobleaching", "movement_artifacts", "spike_artifacts", "jump_artifacts", "shot_noise", "gaussian_noise", "full_signal")


def from_parameters(event_label: str = "trial_cue", n_events: int | None = 10, event_amplitude: float = 0.02, event_kernel: str = "gamma", event_options: dict | None = None, event_buffer_sec: float | None = 10.0, **given) -> Recording:
    """A recording with one evenly spaced event."""
    own = Recording(**given)
    options = {"shape_k": 3, "tau_sec": 1.0} if event_options is None and event_kernel == "gamma" else event_options or {}
    return own.with_event(event_label, evenly_spaced(own.time, n_events, event_buffer_sec, event_buffer_sec), event_amplitude, event_kernel, **options)


def long_form(of: Recording, layers: list[str] | None = None, condensed: bool = True, factor: int | None = None) -> pd.DataFrame:
    """``time, layer, trace, value`` of both channels, means of ``factor`` samples if given."""
    got, parts = of.render(), []
    cut = lambda x: x if factor in (None, 0, 1) else x[: len(x) // factor * factor].reshape(-1, factor).mean(axis=1)
    for trace, prefix in (("experimental", ""), ("isosbestic", "iso_")):
        for layer in _CONDENSED if condensed else _FULL:
            if layers is None or layer in layers:
                parts.append(pd.DataFrame({"time": cut(got["time"]), "layer": layer, "trace": trace, "value": cut(got[layer if layer in _SHARED else prefix + layer])}))
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"time": [], "layer": [], "trace": [], "value": []})


def experiment_table(of: Recording, export_events: bool = True) -> pd.DataFrame:
    """Wide table as the CSV reader takes it, with the true trace (spelled as its readers expect) and a flag per event label."""
    got = of.render()
    t = got["time"]
    out = pd.DataFrame({"time": t, "signal": got["full_signal"], "isosbestic": got["iso_full_signal"], "nueral_trace": got["neural_trace"]})
    for label, e in of.events.items() if export_events else ():
        at = np.clip(np.searchsorted(t, e.onsets), 0, len(t) - 1)
        before = np.maximum(at - 1, 0)
        at = np.where(np.abs(t[before] - e.onsets) <= np.abs(t[at] - e.onsets), before, at) if len(e.onsets) else at
        flags = np.zeros(len(t), bool)
        flags[at] = True
        out[label] = flags
    return out


# -- libraries ----------------------------------------------------------------------


class Library:
    """Recordings of every combination of options, ``replicates`` of each, with seeds of their own."""

    def __init__(self, constants: dict, options: dict[str, list], replicates: int = 1, seed: int | None = None):
        known = {*inspect.signature(from_parameters).parameters, *Recording.__dataclass_fields__} - {"given"}
        if wrong := [k for k in (*constants, *options) if k not in known]:
            raise TypeError(f"unexpected {wrong}")
        combos = [dict(zip(options, v, strict=True)) for v in itertools.product(*options.values())]
        seeds = np.arange(1, len(combos) * replicates + 1)
        np.random.default_rng(seed).shuffle(seeds)
        self.params = [constants | c | {"seed": int(seeds[i * replicates + r])} for i, c in enumerate(combos) for r in range(replicates)]

    def update(self, given: dict) -> None:
        self.params = [p | given for p in self.params]

    def table(self, spark: SparkSession) -> DataFrame:
        """``lib_id, params`` (JSON)."""
        return spark.createDataFrame([(k, json.dumps(p)) for k, p in enumerate(self.params)], "lib_id long, params string")

    def generate(self, spark: SparkSession, operation: Callable[[Recording], Recording] | None = None) -> DataFrame:
        """``lib_id, idx, time, signal, isosbestic, neural_trace, labels`` of all recordings, each drawn by one task."""
        return rendered(self.table(spark), operation)

    def write(self, spark: SparkSession, path: str, operation: Callable[[Recording], Recording] | None = None) -> None:
        """Parameters as JSON lines and the recordings as Parquet partitioned by their number, below ``path``."""
        self.table(spark).write.mode("errorifexists").json(f"{path}/params")
        self.generate(spark, operation).write.mode("errorifexists").partitionBy("lib_id").parquet(f"{path}/recordings")


def rendered(params: DataFrame, operation: Callable[[Recording], Recording] | None = None) -> DataFrame:
    """The recordings of a parameter table ``lib_id, params``."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for lib_id, text in part[["lib_id", "params"]].itertuples(index=False):
                given = json.loads(text)
                of = from_parameters(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})
                of = operation(of) if operation else of
                t = experiment_table(of)
                labels = [[name for name in of.events if on[name]] for on in t[list(of.events)].to_dict("records")] if of.events else [[] for _ in range(len(t))]
                yield pd.DataFrame({"lib_id": lib_id, "idx": np.arange(len(t)), "time": t["time"], "signal": t["signal"], "isosbestic": t["isosbestic"], "neural_trace": t["nueral_trace"], "labels": labels})

    n = max(1, params.count())
    return params.repartition(n, F.col("lib_id")).mapInPandas(run, "lib_id long, idx long, time double, signal double, isosbestic double, neural_trace double, labels array<string>")


def samples_and_events(recordings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Recordings as the extraction takes them: samples and events (``lib_id, label, t, event_id``)."""
    s = recordings.select("lib_id", "idx", F.col("time").alias("t"), "signal", "isosbestic", "neural_trace")
    e = recordings.select("lib_id", F.explode("labels").alias("label"), F.col("time").alias("t"), F.col("idx").alias("event_id"))
    return s, e
