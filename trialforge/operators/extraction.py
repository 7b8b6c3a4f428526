"""Event-aligned extraction with every option: alignment, annotation, centring, windows, policies and normalisation as one lazy plan.

Trials come back packed, one row each, so what follows works on arrays.
Samples and trials meet on (recording, index) or by one sort along the time, so
a long recording is the only unit that a task has to order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from numbers import Real

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vec
from .relational import bracket, nearest
from .windowing import alignments, annotate, centred

#: Label of alignments that are given as times.
TIMES = "ALIGNMENTS"


@dataclass(frozen=True)
class Extracted:
    """Trials and baselines (``key, trial_num, align_event, align_t, start_time, stop_time, events, x``), their axes, and the alignments dropped."""

    trials: DataFrame
    grid: list[float]
    dropped: DataFrame
    baselines: DataFrame | None = None
    baseline_grid: list[float] | None = None


def resolve(samples: DataFrame, events: DataFrame, align_to: str | float | Sequence, key: str, label: str, t: str, tie: str) -> tuple[DataFrame, bool]:
    """Alignments of one label, several labels pooled in time order, or given times for every recording; whether they are times.

    No label is a ValueError, one that no event has a KeyError.
    """
    wanted = [align_to] if isinstance(align_to, (str, Real)) else list(align_to)
    if not wanted:
        raise ValueError("nothing to align to")
    if all(isinstance(x, str) for x in wanted):
        check_labels(events, wanted, label)
        return alignments(events, wanted, key, label, t, tie), False
    if any(isinstance(x, str) for x in wanted):
        raise ValueError("labels and times cannot be mixed")
    table = F.array(*[F.struct(F.lit(float(x)).alias("at"), F.lit(k).cast("long").alias("ord")) for k, x in enumerate(wanted)])
    each = samples.select(key).distinct().select(key, F.explode(table).alias("w"))
    return each.select(key, F.lit(TIMES).alias("align_event"), F.col("w.at").alias("align_t"), F.col("w.ord").alias("trial_ord")), True


def check_labels(events: DataFrame, wanted: Sequence[str], label: str) -> None:
    there = {r[0] for r in events.where(F.col(label).isin(list(wanted))).select(label).distinct().collect()}  # as many as were asked for
    if missing := [x for x in wanted if x not in there]:
        raise KeyError(f"no events {missing}")


def grid_of(bounds: tuple[float, float], freq: float, how: str) -> list[float]:
    """The axis of a window: whole samples around the snapped centre, or steps from the lower bound."""
    low, high = bounds
    if low > high:
        raise ValueError("bounds are the wrong way round")
    n = round((high - low) * freq)
    if n < 1:
        raise ValueError("the window holds no sample")
    return [(round(low * freq) + k) / freq for k in range(n)] if how == "nearest" else [low + k / freq for k in range(n)]


def windows(rows: DataFrame, samples: DataFrame, center: str, bounds: tuple[float, float], freq: float, how: str, key: str, t: str, idx: str, value: str, by: list[str]) -> DataFrame:
    """``by, at, ok, x``: the centre used, whether the window lies within the recording, and its values (null if not).

    ``nearest`` snaps the centre to a sample and takes samples by index, an end
    repeated where the recording has gaps near it; ``interp`` reads between the
    samples around each point.
    """
    grid = grid_of(bounds, freq, how)
    n, first = len(grid), round(bounds[0] * freq)
    s = samples.select(key, F.col(t).alias("_t"), F.col(idx).alias("_i"), F.col(value).cast("double").alias("_v"))
    ends = s.groupBy(key).agg(F.min("_t").alias("_a"), F.max("_t").alias("_b"), F.max("_i").alias("_last"))
    own = rows.select(*by, F.col(center).alias("_c"))
    steps = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_k")
    if how == "nearest":
        at = nearest(own, s, key, "_c", "_t", "_i").select(*by, F.col("near").alias("at"), F.col("near_id").alias("_j")).join(ends, key, "left")
        ok = (F.col("at") + min(grid) >= F.col("_a")) & (F.col("at") + max(grid) <= F.col("_b"))
        at = at.withColumn("ok", F.coalesce(ok, F.lit(False)))
        each = at.where("ok").select(*by, "_j", "_last", steps).select(*by, "_k", F.least(F.greatest(F.col("_j") + first + F.col("_k"), F.lit(0)), F.col("_last")).alias("_i"))
        points = each.join(s.select(key, "_i", "_v"), [key, "_i"])
    elif how == "interp":
        low, high = bounds
        at = own.withColumnRenamed("_c", "at").join(ends, key, "left")
        at = at.withColumn("ok", F.coalesce((F.col("at") + low >= F.col("_a")) & (F.col("at") + high <= F.col("_b")), F.lit(False)))
        each = at.where("ok").select(*by, "at", steps).select(*by, "_k", (F.col("at") + low + F.col("_k") / freq).alias("_q"))
        around = bracket(each, s, key, "_q", "_t", "_i", "_v")
        p, q = F.col("_p"), F.col("_n")
        between = p["_v"] + (q["_v"] - p["_v"]) * (F.col("_q") - p["t"]) / (q["t"] - p["t"])
        points = around.withColumn("_v", F.when(p["t"] < q["t"], between).otherwise(F.coalesce(p["_v"], q["_v"])))
    else:
        raise ValueError(f"unknown strategy {how}")
    packed = points.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", F.col("_v").alias("v")))), lambda e: e["v"]).alias("x"))
    return at.select(*by, "at", "ok").join(packed, by, "left")


def extract(
    samples: DataFrame, events: DataFrame, align_to: str | float | Sequence, trial_bounds: tuple[float, float], freq: float, *,
    center_on: str | Sequence[str] | None = None, baseline_bounds: tuple[float, float] | None = None, tolerances: dict[str, tuple[float, float] | None] | None = None,
    normalisation: str | Callable[[Column, Column | None], Column] = "none", check_overlap: bool = True, all_events: bool = False, alignment: str = "nearest",
    invalid: str = "drop", conflict: str = "first", key: str = "user_id", label: str = "event_type", t: str = "t", idx: str = "idx", value: str = "value", tie: str = "event_id",
) -> Extracted:
    """Trials around events.

    The trial is centred on the last of ``center_on`` that lies within its
    tolerance (the trial bounds by default), else on the alignment; the baseline
    always on the alignment.  More than one of them is a ValueError unless
    ``check_overlap`` is off.  ``events`` of a trial maps each annotated label to
    its time from the centre: the labels of ``tolerances`` and ``center_on``, or
    with ``all_events`` every label.  ``conflict`` picks among several events of
    a label: ``first``, ``last``, ``mean``, or ``all``, which numbers the later
    ones ``<label>_occurrence_#2`` and so on.

    A window that leaves the recording drops its trial, or with
    ``invalid="error"`` is an error; no trial left is an error too.
    ``normalisation`` is ``none``, ``zscore``, ``zero``, ``mad``, ``amp`` (these
    need baseline bounds) or a function of the signal and the baseline.
    """
    if not callable(normalisation) and normalisation not in vec.NORMALISATIONS:
        raise ValueError(f"unknown normalisation {normalisation}")
    if baseline_bounds is None and not callable(normalisation) and normalisation != "none":
        raise ValueError(f"{normalisation} needs baseline bounds")
    if invalid not in ("drop", "error"):
        raise ValueError(f"unknown policy {invalid}")
    if alignment not in ("nearest", "interp"):
        raise ValueError(f"unknown strategy {alignment}")
    by = [key, "trial_ord"]
    trials, _ = resolve(samples, events, align_to, key, label, t, tie)
    center_on = [center_on] if isinstance(center_on, str) else list(center_on or [])
    if center_on:
        check_labels(events, center_on, label)
    near = dict(tolerances or {})
    if all_events:
        near = {r[0]: trial_bounds for r in events.where(F.col(label).isNotNull()).select(label).distinct().collect()} | near  # the labels, not the events
    near = dict.fromkeys(center_on, trial_bounds) | near
    near = {k: trial_bounds if v is None else v for k, v in near.items()}

    notes = None
    if near:
        # events outside the recording are no candidates
        ends = samples.groupBy(F.col(key).alias("_ek")).agg(F.min(t).alias("_ea"), F.max(t).alias("_eb"))
        inside = events.join(ends, (F.col(key) == F.col("_ek")) & F.col(t).between(F.col("_ea"), F.col("_eb"))).drop("_ek", "_ea", "_eb")
        notes = annotate(trials, inside, near, key, label, t, conflict, tie)
    if center_on:
        trials = centred(trials, notes, center_on, key)
        if check_overlap and trials.where("n_centers > 1").limit(1).count():
            raise ValueError(f"several of {center_on} in one trial")
    else:
        trials = trials.withColumn("center_t", F.col("align_t"))
    trials = trials.select(*by, "align_event", "align_t", "center_t")

    args = (freq, alignment, key, t, idx, value, by)
    out = trials.join(windows(trials, samples, "center_t", trial_bounds, *args), by)
    if baseline_bounds is not None:
        base = windows(trials, samples, "align_t", baseline_bounds, *args).select(*by, F.col("at").alias("b_at"), F.col("ok").alias("b_ok"), F.col("x").alias("b_x"))
        out = out.join(base, by).withColumn("ok", F.col("ok") & F.col("b_ok"))
    out = out.withColumn("align_n", F.col("align_t"))
    dropped = out.where(~F.col("ok")).select(*by, "align_event", "align_t")
    if invalid == "error" and dropped.limit(1).count():
        raise ValueError("a window leaves the recording")
    kept = out.where("ok")
    if not kept.limit(1).count():
        raise ValueError("no trial is left")

    if notes is not None:
        told = notes
        if alignment == "nearest":
            told = nearest(notes.where("ev_t is not null"), samples.select(key, F.col(t).alias("_st"), F.col(idx).alias("_si")), key, "ev_t", "_st", "_si").drop("ev_t", "near_id").withColumnRenamed("near", "ev_t")
        name = F.when(F.col("occurrence") > 1, F.concat("label", F.lit("_occurrence_#"), F.col("occurrence"))).otherwise(F.col("label"))
        told = told.where("ev_t is not null").groupBy(*by).agg(F.collect_list(F.struct(name.alias("name"), F.col("ev_t").alias("at"))).alias("_notes"))
        kept = kept.join(told, by, "left")
    else:
        kept = kept.withColumn("_notes", F.array().cast("array<struct<name:string,at:double>>"))
    kept = kept.withColumn("_notes", F.array_sort(F.coalesce("_notes", F.array())))
    kept = kept.withColumn("trial_num", F.row_number().over(Window.partitionBy(key).orderBy("trial_ord")))
    signal = F.col("x")
    if callable(normalisation):
        signal = normalisation(F.col("x"), F.col("b_x") if baseline_bounds is not None else None)
    elif normalisation != "none":
        signal = vec.normalise(F.col("x"), F.col("b_x"), normalisation)

    def described(at: str, grid: list[float], x: Column) -> DataFrame:
        marks = F.map_from_entries(F.transform("_notes", lambda e: F.struct(e["name"], e["at"] - F.col(at))))
        return kept.select(key, "trial_num", "align_event", "align_t", (F.col(at) + min(grid)).alias("start_time"), (F.col(at) + max(grid)).alias("stop_time"), marks.alias("events"), x.alias("x"))

    grid = grid_of(trial_bounds, freq, alignment)
    if baseline_bounds is None:
        return Extracted(described("at", grid, signal), grid, dropped)
    own = grid_of(baseline_bounds, freq, alignment)
    return Extracted(described("at", grid, signal), grid, dropped, described("b_at", own, F.col("b_x")), own)
