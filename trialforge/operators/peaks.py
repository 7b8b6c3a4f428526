"""Peaks and artifacts: thresholded runs of samples and their metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vec
from .relational import interval_join, merge_gaps, runs


def threshold_runs(trials: DataFrame, trial: str, x: str = "x", threshold: float = 3.0, direction: str = "both", center: str = "median", scale: str = "mad") -> DataFrame:
    """Runs beyond centre +- threshold x scale of their own trial: ``trial, direction, start, stop, base`` (strict comparison)."""
    centers = {"median": vec.median, "mean": vec.mean, "zero": lambda c: F.lit(0.0)}
    scales = {"mad": vec.mad, "std": vec.std, "one": lambda c: F.lit(1.0)}
    if direction not in ("both", "positive", "negative") or center not in centers or scale not in scales:
        raise ValueError("unknown direction, center or scale")
    signs = {"both": [1, -1], "positive": [1], "negative": [-1]}[direction]
    own = trials.withColumn("base", centers[center](F.col(x))).withColumn("_s", scales[scale](F.col(x)))
    long = own.select(trial, "base", "_s", F.posexplode(x).alias("i", "v")).withColumn("sign", F.explode(F.array(*[F.lit(s) for s in signs])))
    flag = F.col("sign") * (F.col("v") - F.col("base")) > threshold * F.col("_s")
    out = runs(long, [trial, "sign", "base"], "i", flag)
    return out.withColumn("direction", F.when(F.col("sign") > 0, "positive").otherwise("negative"))


def merged_close(found: DataFrame, trial: str, distance: int) -> DataFrame:
    return merge_gaps(found, [trial, "sign", "base", "direction"], distance) if distance else found


def sized(found: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    size = F.col("stop") - F.col("start") + 1
    out = found.where(size >= low) if low else found
    return out.where(size <= high) if high else out


def metrics(found: DataFrame, trials: DataFrame, trial: str, x: str = "x", step: float = 1.0) -> DataFrame:
    """Peak metrics of inclusive runs, per the usual definitions: first extreme, signed height, prominences, duration, trapezoid area, half-maximum width."""
    own = found.join(trials.select(trial, x), trial)
    y = F.slice(F.col(x), F.col("start") + 1, F.col("stop") - F.col("start") + 1)
    own = own.withColumn("y", y).withColumn("q", F.transform("y", lambda v: F.col("sign") * (v - F.col("base"))))
    own = own.withColumn("p", (F.array_position("q", F.array_max("q")) - 1).cast("int"))
    height = F.col("sign") * F.get("q", F.col("p"))
    half = F.col("base") + 0.5 * (F.get("q", F.col("p")) - F.col("base"))
    left = F.coalesce(F.array_max(F.filter(F.transform("q", lambda v, i: F.when((v <= half) & (i <= F.col("p")), i)), lambda v: v.isNotNull())), F.lit(0))
    right = F.coalesce(F.array_min(F.filter(F.transform("q", lambda v, i: F.when((v <= half) & (i >= F.col("p")), i)), lambda v: v.isNotNull())), F.size("q") - 1)
    own = own.withColumn("height", height).withColumn("left_prominence", height - F.col("sign") * F.get("q", F.lit(0))).withColumn("right_prominence", height - F.col("sign") * F.element_at("q", -1))
    return own.select(
        trial, "direction", "start", "stop", F.col("base").alias("peak_baseline"), (F.col("start") + F.col("p")).cast("int").alias("peak_idx"), F.get("y", F.col("p")).alias("peak_value"), "height",
        F.least("left_prominence", "right_prominence").alias("prominence"), ((F.col("stop") - F.col("start")) * step).cast("double").alias("duration"), ((right - left) * step).cast("double").alias("width"),
        vec.trapezoid(F.transform("y", lambda v: v - F.col("base")), F.lit(step)).alias("area"),
    )


def filter_peaks(peaks: DataFrame, trial: str, on: str, how: str, value: float | tuple[float, float] | None = None) -> DataFrame:
    """``lowest`` and ``highest`` keep ties, ``closest`` one per trial, ``between`` is inclusive, ``equals``."""
    w = Window.partitionBy(trial)
    if on not in peaks.columns:
        raise KeyError(on)
    if how in ("lowest", "highest"):
        best = (F.min if how == "lowest" else F.max)(on).over(w)
        return peaks.withColumn("_b", best).where(F.col(on) == F.col("_b")).drop("_b")
    if how == "closest":
        return peaks.withColumn("_r", F.row_number().over(w.orderBy(F.abs(F.col(on) - value), "start"))).where("_r = 1").drop("_r")
    if how == "between":
        return peaks.where(F.col(on).between(*value))
    if how == "equals":
        return peaks.where(F.col(on) == value)
    raise ValueError(f"unknown filter {how}")


def artifact_intervals(scored: DataFrame, key: str, idx: str, score: str, limit: float, left: int, right: int) -> DataFrame:
    """Runs of outlying scores, widened and merged where they touch, clipped to the recording: half-open ``start, stop``."""
    last = scored.groupBy(key).agg(F.max(idx).alias("_last"))
    found = runs(scored, [key], idx, F.abs(score) > limit).withColumn("start", F.col("start") - left).withColumn("stop", F.col("stop") + right)
    out = merge_gaps(found, [key], 0).join(last, key)
    return out.select(key, F.greatest("start", F.lit(0)).alias("start"), (F.least("stop", "_last") + 1).alias("stop"))


def artifact_metrics(found: DataFrame, samples: DataFrame, key: str, idx: str, t: str, value: str, buffer: int) -> DataFrame:
    """Medians of the buffers before and after, their change, the signed largest deviation and the duration of each interval."""
    s = samples.select(key, F.col(idx).alias("_i"), F.col(t).alias("_t"), F.col(value).alias("_v"))
    wide = found.withColumn("_lo", F.col("start") - buffer + 1).withColumn("_hi", F.col("stop") + buffer - 1)
    near = interval_join(wide, s, key, "_lo", "_hi", "_i", float(4 * buffer + 64), "inner").drop("_lo", "_hi")
    by = [key, "start", "stop"]
    inside = (F.col("_i") >= F.col("start")) & (F.col("_i") < F.col("stop"))
    known = inside & F.col("_v").isNotNull()
    got = near.groupBy(*by).agg(
        F.median(F.when(F.col("_i") <= F.col("start"), F.col("_v"))).alias("before"), F.median(F.when(F.col("_i") >= F.col("stop"), F.col("_v"))).alias("after"),
        F.max(F.when(F.col("_i") == F.col("start"), F.col("_t"))).alias("start_time"), F.max(F.when(F.col("_i") <= F.col("stop"), F.col("_t"))).alias("stop_time"),
        F.max(F.when(known, F.struct(F.col("_v").alias("v"), (-F.col("_i")).alias("i")))).alias("_high"), F.min(F.when(known, F.struct(F.col("_v").alias("v"), F.col("_i").alias("i")))).alias("_low"), F.count(F.when(inside, 1)).alias("_n"),
    ).where("_n > 0")
    # the farthest sample is the highest or the lowest one, of two equally far the earlier
    up, down = F.col("_high.v") - F.col("before"), F.col("_low.v") - F.col("before")
    first_up = (F.abs(up) > F.abs(down)) | ((F.abs(up) == F.abs(down)) & (-F.col("_high.i") <= F.col("_low.i")))
    return got.select(*by, "start_time", "stop_time", "before", "after", (F.col("after") - F.col("before")).alias("baseline_change"), F.when(first_up, up).otherwise(down).alias("amplitude"), (F.col("stop_time") - F.col("start_time")).alias("duration"))


def artifact_score(found: DataFrame, key: str) -> DataFrame:
    return found.groupBy(key).agg(F.sum(F.log1p(F.abs("amplitude")) * F.col("duration")).alias("artifact_score"), F.count("*").alias("n"))


def jump_corrected(samples: DataFrame, jumps: DataFrame, key: str, idx: str, value: str) -> DataFrame:
    """Subtracts from every sample the baseline changes of all jumps that ended at or before it: one union and a running sum, no pair join."""
    a = samples.select(key, F.col(idx).alias("_i"), F.lit(1).alias("_k"), F.col(value).alias("_v"), F.lit(0.0).alias("_c"))
    b = jumps.select(key, F.col("stop").alias("_i"), F.lit(0).alias("_k"), F.lit(None).cast("double").alias("_v"), F.col("baseline_change").alias("_c"))
    w = Window.partitionBy(key).orderBy("_i", "_k").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_s", F.sum("_c").over(w)).where("_k = 1")
    return both.select(key, F.col("_i").alias(idx), F.col("_v").alias(value), (F.col("_v") - F.col("_s")).alias("corrected"))


def rolling_runs(trials: DataFrame, trial: str, width: int, x: str = "x", threshold: float = 3.0, center: str = "median", scale: str = "mad") -> DataFrame:
    """Runs beyond the centre +- threshold x scale of the window around each sample: ``trial, direction, start, stop``.

    A window of ``width`` samples starts width // 2 before its sample; beyond
    an end it runs back along the trial, the end sample repeated.
    """
    centers = {"median": vec.median, "mean": vec.mean, "zero": lambda c: F.lit(0.0)}
    scales = {"mad": vec.mad, "std": vec.std, "one": lambda c: F.lit(1.0)}
    if center not in centers or scale not in scales or width < 1:
        raise ValueError("unknown center or scale, or an empty window")
    n = F.size(x)

    def at(j):
        j = F.pmod(j, 2 * n)
        return F.get(x, F.when(j < n, j).otherwise(2 * n - 1 - j).cast("int"))

    steps = F.sequence(F.lit(0), F.lit(width - 1))
    windows = F.transform(x, lambda v, i: F.struct(v.alias("v"), F.transform(steps, lambda k: at(i - width // 2 + k)).alias("w")))
    long = trials.select(trial, F.posexplode(windows).alias("i", "e")).select(trial, "i", "e.v", "e.w")
    long = long.select(trial, "i", "v", centers[center](F.col("w")).alias("_c"), scales[scale](F.col("w")).alias("_s"), F.explode(F.array(F.lit(1), F.lit(-1))).alias("sign"))
    out = runs(long, [trial, "sign"], "i", F.col("sign") * (F.col("v") - F.col("_c")) > threshold * F.col("_s"))
    return out.select(trial, F.when(F.col("sign") > 0, "positive").otherwise("negative").alias("direction"), "start", "stop")


# -- results -----------------------------------------------------------------------


def detected(trials: DataFrame, trial: str, freq: float, x: str = "x", threshold: float = 3.0, direction: str = "both", center: str = "median", scale: str = "mad", merge: float = 0.0, shortest: float | None = None, longest: float | None = None) -> DataFrame:
    """Peaks with their metrics, durations given in seconds (cut to whole samples): runs are merged before sizes are looked at; in order of trial and start."""
    runs_ = merged_close(threshold_runs(trials, trial, x, threshold, direction, center, scale), trial, int(merge * freq))
    runs_ = sized(runs_, int(shortest * freq) if shortest else None, int(longest * freq) if longest else None)
    return metrics(runs_, trials, trial, x, 1 / freq).orderBy(trial, "start")


def peak_counts(trials: DataFrame, peaks: DataFrame, trial: str) -> DataFrame:
    """``n_peaks`` of every trial, those without any included."""
    return trials.select(trial).join(peaks.groupBy(trial).agg(F.count("*").alias("n_peaks")), trial, "left").withColumn("n_peaks", F.coalesce("n_peaks", F.lit(0)).cast("long"))


def one_per_trial(peaks: DataFrame, trial: str) -> bool:
    """Whether no trial has several peaks."""
    return not peaks.groupBy(trial).count().where("count > 1").limit(1).count()


def read_csv(spark, path: str, schema: str) -> DataFrame:
    """A result table written by ``sinks.write_csv``."""
    return spark.read.csv(path, header=True, schema=schema)
