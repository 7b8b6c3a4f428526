"""Event-aligned trials: alignment, annotation, centring and windows, as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .relational import interval_join, occurrences, pick


def alignments(events: DataFrame, align_to: list[str], key: str = "user_id", label: str = "event_type", t: str = "t", tie: str = "event_id") -> DataFrame:
    """Pooled alignment events in time order, ties by position of the label in the list: ``key, align_event, align_t, trial_ord``."""
    if not align_to:
        raise ValueError("no label to align to")
    place = F.array_position(F.array(*[F.lit(x) for x in align_to]), F.col(label))
    w = Window.partitionBy(key).orderBy(t, place, tie)
    return events.where(F.col(label).isin(align_to)).select(key, F.col(label).alias("align_event"), F.col(t).alias("align_t"), (F.row_number().over(w) - 1).cast("long").alias("trial_ord"))


def annotate(trials: DataFrame, events: DataFrame, tolerances: dict[str, tuple[float, float]], key: str = "user_id", label: str = "event_type", t: str = "t", rule: str = "first", tie: str = "event_id") -> DataFrame:
    """Events of each label near each trial, long form: ``key, trial_ord, label, occurrence, ev_t``.

    All labels take part in one range join; the tolerances are a small literal table.
    """
    for name, (low, high) in tolerances.items():
        if low > high:
            raise ValueError(f"bounds of {name} are the wrong way round")
    table = F.array(*[F.struct(F.lit(n).alias("label"), F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi")) for n, (a, b) in tolerances.items()])
    left = trials.select(key, "trial_ord", "align_t", F.explode(table).alias("w"))
    left = left.select(key, "trial_ord", "align_t", F.col("w.label").alias("label"), (F.col("align_t") + F.col("w.lo")).alias("lo"), (F.col("align_t") + F.col("w.hi")).alias("hi"))
    right = events.where(F.col(label).isin(list(tolerances))).select(key, F.col(label).alias("ev_label"), F.col(t).alias("ev_t"), F.col(tie).alias("ev_tie"))
    width = max(max(b - a for a, b in tolerances.values()), 1e-6)
    joined = interval_join(left, right, key, "lo", "hi", "ev_t", width, "inner").where("label = ev_label")
    by = [key, "trial_ord", "label"]
    if rule == "all":
        return occurrences(joined, by, "ev_t", "ev_tie").select(*by, "occurrence", "ev_t")
    return pick(joined, by, "ev_t", rule, "ev_t").withColumn("occurrence", F.lit(1)).select(*by, "occurrence", "ev_t")


def centred(trials: DataFrame, notes: DataFrame, center_on: list[str], key: str = "user_id") -> DataFrame:
    """``center_t`` (the last label of the list that is present, else the alignment) and ``n_centers``."""
    got = notes.where(F.col("occurrence") == 1).groupBy(key, "trial_ord").pivot("label", center_on).agg(F.first("ev_t"))
    out = trials.join(got, [key, "trial_ord"], "left")
    present = sum((F.col(f"`{c}`").isNotNull().cast("int") for c in center_on), F.lit(0))
    return out.withColumn("center_t", F.coalesce(*[F.col(f"`{c}`") for c in reversed(center_on)], F.col("align_t"))).withColumn("n_centers", present)


def extract_trials(samples: DataFrame, trials: DataFrame, bounds: tuple[int, int], key: str = "user_id", idx: str = "idx", value: str = "value", center: str = "center_idx") -> DataFrame:
    """Windows of samples by index, from ``bounds[0]`` to before ``bounds[1]`` around each trial's centre, in long form.

    Trials whose window leaves the recording are dropped.  The join is on the recording and a bucket of indexes, so long recordings are shared out.
    """
    low, high = bounds
    ends = samples.groupBy(key).agg(F.max(idx).alias("_last"))
    ok = trials.join(ends, key).where((F.col(center) + low >= 0) & (F.col(center) + high - 1 <= F.col("_last"))).drop("_last")
    left = ok.withColumn("_lo", F.col(center) + low).withColumn("_hi", F.col(center) + high - 1)
    right = samples.select(key, F.col(idx).alias("_i"), F.col(value).alias("signal"))
    out = interval_join(left, right, key, "_lo", "_hi", "_i", float(max(high - low, 1)), "inner")
    return out.withColumn("time_idx", (F.col("_i") - F.col("_lo")).cast("int")).drop("_lo", "_hi", "_i")
