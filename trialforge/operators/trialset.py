"""A set of trials: observations, the signal, further layers of the same shape, one time axis and metadata.

The frame has one row per trial with a signal ``x`` and a column per layer,
each ``array<double>`` as long as the axis.  Every method returns a new set.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vec
from . import trials

#: Point-wise aggregates by name; a function of a column may be given instead.
METHODS: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg, "std": F.stddev_pop, "sem": lambda c: F.stddev_pop(c) / F.sqrt(F.count(c)), "median": F.median, "min": F.min, "max": F.max, "sum": F.sum, "n": F.count,
}


def _method(how: str | Callable[[Column], Column]) -> Callable[[Column], Column]:
    if callable(how):
        return how
    if how not in METHODS:
        raise ValueError(f"unknown method {how}")
    return METHODS[how]


def _each(column: str, name: str) -> Column:
    """One field of an array of structs."""
    return F.transform(column, lambda e: e[name])


@dataclass(frozen=True)
class TrialSet:
    frame: DataFrame
    axis: tuple[float, ...]
    layers: tuple[str, ...] = ()
    metadata: dict = field(default_factory=dict)
    x: str = "x"

    @property
    def arrays(self) -> tuple[str, ...]:
        return (self.x, *self.layers)

    @property
    def obs(self) -> DataFrame:
        return self.frame.drop(*self.arrays)

    @property
    def frequency(self) -> float | None:
        """Points per unit of the axis."""
        return (len(self.axis) - 1) / (self.axis[-1] - self.axis[0]) if len(self.axis) > 1 and self.axis[-1] > self.axis[0] else None

    def checked(self) -> TrialSet:
        """An error unless the axis rises and every array has its length (one aggregate)."""
        if any(b <= a for a, b in zip(self.axis, self.axis[1:])):
            raise ValueError("the time axis must rise")
        wrong = self.frame.agg(*[F.max((~F.coalesce(F.size(c) == len(self.axis), F.lit(False))).cast("int")).alias(f"w{k}") for k, c in enumerate(self.arrays)]).first()
        bad = [c for c, w in zip(self.arrays, wrong, strict=True) if w]
        if bad:
            raise ValueError(f"{bad} differ from the axis in length")
        return self

    def layer(self, name: str) -> DataFrame:
        if name not in self.layers:
            raise KeyError(name)
        return self.frame.select(*self.obs.columns, F.col(name).alias(self.x))

    def with_frame(self, frame: DataFrame) -> TrialSet:
        return replace(self, frame=frame)

    def add_obs(self, values: dict, keys: Sequence[str] | None = None, ordinal: str = "trial_ord") -> TrialSet:
        """Columns of one value each, or of a list with a value per ordinal; a key that is missing gives nulls."""
        out = self.frame
        for k in keys or values:
            v = values.get(k)
            if isinstance(v, (list, tuple)):
                out = out.withColumn(k, F.get(F.array(*[F.lit(e) for e in v]), F.col(ordinal).cast("int")))
            else:
                out = out.withColumn(k, v if isinstance(v, Column) else F.lit(v))
        return self.with_frame(out)

    def add_metadata(self, values: dict, keys: Sequence[str] | None = None) -> TrialSet:
        return replace(self, metadata=self.metadata | {k: values.get(k) for k in keys or values})

    def group_labels(self, columns: Sequence[str], name: str = "group") -> TrialSet:
        """``v1_v2`` of the columns."""
        return self.with_frame(self.frame.withColumn(name, F.concat_ws("_", *[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in columns])))

    def labels(self, columns: Sequence[str]) -> TrialSet:
        """``label``: "col: val, col2: val2"; a column that is missing is a KeyError."""
        for c in columns:
            if c not in self.frame.columns:
                raise KeyError(c)
        return self.with_frame(trials.labels(self.frame, list(columns)))

    def to_long(self, keep: Sequence[str] | None = None, layer: str | None = None, err_layer: str | None = None) -> DataFrame:
        """``keep, time_idx, time, signal`` and with an error layer ``error``; both come from one explode, so nothing is joined."""
        for c in (layer, err_layer):
            if c is not None and c not in self.layers:
                raise KeyError(c)
        parts = [F.col(layer or self.x).alias("signal"), *([F.col(err_layer).alias("error")] if err_layer else [])]
        each = F.posexplode(F.arrays_zip("signal", *(["error"] if err_layer else []))).alias("time_idx", "_e")
        axis = F.array(*[F.lit(float(v)) for v in self.axis])
        keep = list(self.obs.columns if keep is None else keep)
        out = self.frame.select(*keep, *parts).select(*keep, each)
        return out.select(*keep, "time_idx", F.get(axis, F.col("time_idx")).alias("time"), "_e.signal", *(["_e.error"] if err_layer else []))

    def to_wide(self, keep: Sequence[str] | None = None, layer: str | None = None) -> DataFrame:
        keep = list(self.obs.columns if keep is None else keep)
        own = self.layer(layer) if layer else self.frame
        return trials.to_wide(own, keep, len(self.axis), self.x)

    def collapse(self, by: Sequence[str] | str | None = None, method: str | Callable[[Column], Column] = "mean", metrics: dict[str, str | Callable[[Column], Column]] | None = None, data_cols: Sequence[str] = (), collapse_cols: Sequence[str] = (), count_col: str | None = "n", ordinal: str | None = None) -> TrialSet:
        """One trial per group: the point-wise ``method`` as signal, each of ``metrics`` as a layer and as ``<column>_<metric>`` of ``data_cols``, lists of ``collapse_cols``, and the group's size.

        Without ``by`` all trials make one group; groups with a null key are
        left out.  Points are aggregated map-side in long form; with
        ``ordinal`` the lists follow it and the groups carry the place of their
        first trial in it.
        """
        by = [by] if isinstance(by, str) else list(by or [])
        metrics = {"std": "std"} if metrics is None else metrics
        own = self.frame
        for c in by:
            own = own.where(F.col(c).isNotNull())
        long = own.select(*by, F.posexplode(self.x).alias("_i", "_v"))
        points = long.groupBy(*by, "_i").agg(_method(method)(F.col("_v")).alias("_x"), *[_method(f)(F.col("_v")).alias(f"_m{k}") for k, f in enumerate(metrics.values())])
        names = ["_x", *[f"_m{k}" for k in range(len(metrics))]]
        packed = points.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_i", *names))).alias("_p"))
        packed = packed.select(*by, *[_each("_p", c).alias(n) for c, n in zip(names, [self.x, *metrics], strict=True)])
        lists = [F.transform(F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("o"), F.col(c).alias("v")))), lambda e: e["v"]).alias(c) if ordinal else F.collect_list(c).alias(c) for c in collapse_cols]
        obs = [_method(method)(F.col(c)).alias(c) for c in data_cols] + [_method(f)(F.col(c)).alias(f"{c}_{m}") for m, f in metrics.items() for c in data_cols] + lists
        obs = ([F.count("*").alias(count_col)] if count_col else []) + obs + ([F.min(ordinal).alias(ordinal)] if ordinal else [])
        if obs:
            told = own.groupBy(*by).agg(*obs)
            packed = told.join(packed, by) if by else told.join(packed)
        return replace(self, frame=packed, layers=tuple(metrics))

    def combine(self, others: Sequence[TrialSet], join: str = "inner", check_time: bool = True, tol: float = 1e-6) -> TrialSet:
        """All trials on the axis of this set; with ``check_time`` another axis is a ValueError.  ``inner`` keeps the columns that all have; metadata that differ go."""
        if join not in ("inner", "outer"):
            raise ValueError(f"unknown join {join}")
        out, meta = self.frame, dict(self.metadata)
        for o in others:
            if len(o.axis) != len(self.axis) or (check_time and any(abs(a - b) > tol for a, b in zip(self.axis, o.axis, strict=True))):
                raise ValueError("the time axes differ")
            out = trials.union_trials(out, o.frame if o.x == self.x else o.frame.withColumnRenamed(o.x, self.x), join)
            meta = {k: v for k, v in meta.items() if k in o.metadata and o.metadata[k] == v}
        return replace(self, frame=out, layers=tuple(c for c in self.layers if c in out.columns), metadata=meta)

    def downsample(self, factor: int) -> TrialSet:
        """Means of whole blocks of the signal, the layers and the axis."""
        if factor in (None, 0, 1):
            return self
        out = self.frame
        for c in self.arrays:
            out = trials.downsample(out, factor, c)
        axis = tuple(sum(self.axis[k * factor : (k + 1) * factor]) / factor for k in range(len(self.axis) // factor))
        return replace(self, frame=out, axis=axis)

    def window(self, centre: Column, bounds: tuple[float, float], how: str = "nearest", policy: str = "drop") -> TrialSet:
        """The signal and every layer, cut around a centre."""
        out, freq, n = self.frame.withColumn("_centre", centre), self.frequency, len(self.axis)
        for k, c in enumerate(self.arrays):
            out = trials.rewindow(out, F.col("_centre"), bounds, freq, n, self.axis[0], how, policy if k == 0 else "drop", c)
        count, low = round((bounds[1] - bounds[0]) * freq), bounds[0]
        start = round(low * freq) / freq if how == "nearest" else low
        return replace(self, frame=out.drop("_centre"), axis=tuple(start + k / freq for k in range(count)))


def from_arrays(spark: SparkSession, obs: list[dict], data: Sequence[Sequence[float]], axis: Sequence[float], layers: dict[str, Sequence[Sequence[float]]] | None = None, metadata: dict | None = None) -> TrialSet:
    """A set from local rows; shapes that differ are a ValueError."""
    layers = layers or {}
    for name, rows in {"data": data, **layers}.items():
        if len(rows) != len(obs) or any(len(r) != len(axis) for r in rows):
            raise ValueError(f"{name} does not have a row per observation and a value per time point")
    if not obs:
        raise ValueError("no observations")
    base = spark.createDataFrame([{"trial_ord": k, **o} for k, o in enumerate(obs)])
    values = spark.createDataFrame([(k, [float(v) for v in data[k]], *[[float(v) for v in rows[k]] for rows in layers.values()]) for k in range(len(obs))], "trial_ord long, x array<double>" + "".join(f", `{c}` array<double>" for c in layers))
    return TrialSet(base.join(values, "trial_ord"), tuple(float(v) for v in axis), tuple(layers), dict(metadata or {})).checked()


def area(of: TrialSet, name: str = "auc", transform: Callable[[Column], Column] | None = None) -> TrialSet:
    """Trapezoid area of each trial over the axis."""
    step = 1 / of.frequency if of.frequency else 1.0
    x = transform(F.col(of.x)) if transform else F.col(of.x)
    return of.with_frame(of.frame.withColumn(name, vec.trapezoid(x, F.lit(step))))
