"""Trial matrices: one row per trial, the signal as ``array<double>``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vec


def filter_rows(trials: DataFrame, condition: Column | list[int] | None, ordinal: str = "trial_ord") -> DataFrame:
    if condition is None:
        return trials
    return trials.where(F.col(ordinal).isin(condition)) if isinstance(condition, list) else trials.where(condition)


def mutate(trials: DataFrame, **columns: object) -> DataFrame:
    """Columns added one after another; a callable gets the frame so far, None is skipped."""
    for name, value in columns.items():
        value = value(trials) if callable(value) and not isinstance(value, Column) else value
        if value is not None:
            trials = trials.withColumn(name, value if isinstance(value, Column) else F.lit(value))
    return trials


def labels(trials: DataFrame, columns: list[str], sep: str = ", ") -> DataFrame:
    """``label``: "col: val, col2: val2"."""
    return trials.withColumn("label", F.concat_ws(sep, *[F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in columns]))


def to_long(trials: DataFrame, keep: list[str], x: str = "x") -> DataFrame:
    return trials.select(*keep, F.posexplode(x).alias("time_idx", "signal"))


def to_wide(trials: DataFrame, keep: list[str], n: int | None = None, x: str = "x", prefix: str = "t") -> DataFrame:
    """One column per point, ``<prefix>_1`` to ``<prefix>_n``; without n the whole axis, the longest trial's, found by one aggregate."""
    if n is None:
        n = trials.agg(F.max(F.size(x))).first()[0] or 0
    return trials.select(*keep, *[F.get(x, F.lit(k)).alias(f"{prefix}_{k + 1}") for k in range(max(n, 0))])


def collapse(trials: DataFrame, by: list[str], x: str = "x") -> DataFrame:
    """Point-wise mean, population deviation, standard error and count of each group; null groups are dropped.

    Long form in and out: partial aggregation happens before the only shuffle.
    """
    long = to_long(trials, by, x)
    for c in by:
        long = long.where(F.col(c).isNotNull())
    return long.groupBy(*by, "time_idx").agg(F.avg("signal").alias("mean"), F.stddev_pop("signal").alias("std"), (F.stddev_pop("signal") / F.sqrt(F.count("signal"))).alias("sem"), F.count("*").alias("n"))


def packed(long: DataFrame, by: list[str], value: str, name: str = "x", order: str = "time_idx") -> DataFrame:
    """Arrays again, in order; a group is one trial's points."""
    got = long.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("_p"))
    return got.withColumn(name, F.transform("_p", lambda s: s[value])).drop("_p")


def collapse_lists(trials: DataFrame, by: list[str], column: str) -> DataFrame:
    return trials.groupBy(*by).agg(F.array_sort(F.collect_list(column)).alias(column), F.count("*").alias("n"))


def value_counts(frame: DataFrame, column: str) -> DataFrame:
    return frame.groupBy(column).agg(F.count("*").alias("n"))


def union_trials(a: DataFrame, b: DataFrame, join: str = "inner") -> DataFrame:
    if join == "outer":
        return a.unionByName(b, allowMissingColumns=True)
    both = [c for c in a.columns if c in b.columns]
    return a.select(*both).unionByName(b.select(*both))


def rewindow(trials: DataFrame, centre: Column, bounds: tuple[float, float], freq: float, n: int, t0: float = 0.0, how: str = "nearest", policy: str = "drop", x: str = "x") -> DataFrame:
    """Cuts a window around a centre (axis ``t0 + i / freq``, n points); ``policy`` drops trials whose window leaves the axis, or raises.

    A null centre is invalid.  ``nearest`` snaps the centre to the earlier of equally near points and is open at the right end; ``interp`` reads
    between points.
    """
    low, high = bounds
    if low > high:
        raise ValueError("bounds are the wrong way round")
    count = round((high - low) * freq)
    last = t0 + (n - 1) / freq
    if how == "nearest":
        off = int(F_rint(low * freq))
        snapped = F.least(F.greatest(F.ceil((centre - t0) * freq - 0.5), F.lit(0)), F.lit(n - 1))
        at = F.lit(t0) + snapped / freq
        valid = (at + off / freq >= t0) & (at + (off + count - 1) / freq <= last)
        value = vec.window(F.col(x), snapped.cast("int") + off, count)
    elif how == "interp":
        valid = (centre + low >= t0) & (centre + high <= last)
        value = vec.interpolate(F.col(x), F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: (centre + low + k / freq - t0) * freq))
    else:
        raise ValueError(f"unknown strategy {how}")
    ok = F.coalesce(valid, F.lit(False))
    if policy == "error":
        if trials.where(~ok).limit(1).count():
            raise ValueError("a window leaves the trial")
    elif policy != "drop":
        raise ValueError(f"unknown policy {policy}")
    return trials.where(ok).withColumn(x, value)


def F_rint(v: float) -> float:
    """Half to even, as numpy rounds."""
    return float(round(v))


def normalised(trials: DataFrame, how: str, baseline: Column, x: str = "x") -> DataFrame:
    return trials.withColumn(x, vec.normalise(F.col(x), baseline, how))


def area(trials: DataFrame, step: float = 1.0, x: str = "x", transform: Callable[[Column], Column] | None = None) -> DataFrame:
    value = transform(F.col(x)) if transform else F.col(x)
    return trials.withColumn("auc", vec.trapezoid(value, F.lit(step)))


def downsample(trials: DataFrame, factor: int, x: str = "x") -> DataFrame:
    return trials if factor in (None, 0, 1) else trials.withColumn(x, vec.block_mean(F.col(x), factor))
