"""Artifacts of recordings: detection by outlying derivatives, spike and jump labels, reference filter, correction.

Detection is a plan over all recordings; correction fills intervals along each
recording and so takes a recording as its unit.  A detector is any function
``samples -> intervals`` with the columns that ``detect`` returns, a corrector
any function ``(samples, intervals) -> samples``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..kernels import signal as kernels
from .experiment import preprocess
from .peaks import artifact_intervals, artifact_metrics
from .recording import difference, mad_scores, spearman
from .relational import interval_join

#: Modified z-score of a normal deviate: the third quartile of the normal distribution.
QUARTILE = 0.6745


def seconds(samples: DataFrame, key: str, t: str, *durations: float) -> list[int]:
    """Durations in samples, cut to whole ones; all recordings must agree (an experiment has one sampling rate), else ValueError."""
    own = samples.groupBy(key).agg((F.count(t) / F.nullif(F.max(t) - F.min(t), F.lit(0.0))).alias("f")).where("f is not null")
    got = own.select(*[F.floor(F.col("f") * d).alias(f"d{k}") for k, d in enumerate(durations)]).distinct().limit(2).collect()
    if len(got) > 1:
        raise ValueError("the recordings differ in their sampling rate: detect them apart, or give samples")
    return [int(v) for v in got[0]] if got else [0] * len(durations)


def detect(samples: DataFrame, key: str, idx: str, t: str, value: str, reference: str | None = None, score: float = 10.0, jump_score: float = 10.0, cutoff: float = 0.5, expand: tuple[int, int] = (1, 2), buffer: int = 1, chunks: int = 100) -> DataFrame:
    """``key, start, stop, start_time, stop_time, before, after, baseline_change, amplitude, duration, jump_score, type``, with a reference also ``reference_cor``.

    Derivatives with a modified z-score beyond ``score`` are widened by
    ``expand`` samples and merged.  The change of level across an interval, per
    sample, is scored against the derivatives of its chunk of the recording (the
    spread being that of the chunks' deviations over the recording's
    intervals): at ``jump_score`` or beyond it is a ``jump``, else a ``spike``;
    without spread any deviation is a jump.  With a reference an interval stays
    only if signal and reference correlate in rank by ``cutoff`` within it.
    """
    own = difference(samples, [key], idx, value)
    found = artifact_intervals(mad_scores(own, [key], "diff"), key, idx, "score", score, *expand)
    told = artifact_metrics(found, samples, key, idx, t, value, buffer)
    size = samples.groupBy(key).agg(F.ceil(F.count("*") / chunks).alias("_size"))
    chunked = own.select(key, idx, "diff").join(size, key).withColumn("_chunk", F.least(F.floor(F.col(idx) / F.col("_size")), F.lit(chunks - 1)))
    # not scaled and divided again: the last bit of a deviation decides whether there is spread
    local = mad_scores(chunked, [key, "_chunk"], "diff", 1.0).groupBy(key, "_chunk").agg(F.first("med").alias("_med"), F.first("mad").alias("_mad"))
    placed = told.join(size, key).withColumn("_chunk", F.least(F.floor(F.floor((F.col("start") + F.col("stop")) / 2) / F.col("_size")), F.lit(chunks - 1)))
    placed = placed.join(local, [key, "_chunk"], "left")
    # over the intervals of a recording, so that they are found once
    own_intervals = Window.partitionBy(key)
    placed = placed.withColumn("_m2", F.median("_mad").over(own_intervals)).withColumn("_spread", F.median(F.abs(F.col("_mad") - F.col("_m2"))).over(own_intervals)).drop("_m2")
    far = QUARTILE * (F.col("baseline_change") / (F.col("stop") - F.col("start")) - F.col("_med"))
    placed = placed.withColumn("_far", far)
    beyond = F.when(F.col("_far") > 0, F.lit(float("inf"))).when(F.col("_far") < 0, F.lit(float("-inf")))
    placed = placed.withColumn("jump_score", F.when(F.col("_spread") > 0, F.col("_far") / F.col("_spread")).otherwise(beyond))
    kind = F.when(F.abs("jump_score") >= jump_score, "jump").when(F.col("jump_score").isNotNull(), "spike")
    out = placed.withColumn("type", kind).drop("_size", "_chunk", "_med", "_mad", "_far", "_spread")
    if reference is None:
        return out
    inside = interval_join(out.select(key, "start", "stop", (F.col("stop") - 1).alias("_hi")), samples.select(key, F.col(idx).alias("_i"), F.col(value).alias("_x"), F.col(reference).alias("_y")), key, "start", "_hi", "_i", 64.0, "inner")
    rho = spearman(inside, [key, "start", "stop"], "_x", "_y").select(key, "start", "stop", F.col("rho").alias("reference_cor"))
    return out.join(rho, [key, "start", "stop"], "left").where(F.col("reference_cor") >= cutoff)


def groups(found: DataFrame, kind: str) -> DataFrame:
    """Intervals of one type; a type that is missing has none."""
    return found.where(F.col("type") == kind)


def types(found: DataFrame) -> list[str]:
    return sorted(r[0] for r in found.where("type is not null").select("type").distinct().collect())  # two at most by ``detect``


def indexes(found: DataFrame, key: str) -> DataFrame:
    """Each index that an interval covers, once: ``key, idx``."""
    return found.where("stop > start").select(key, F.explode(F.sequence(F.col("start"), F.col("stop") - 1)).alias("idx")).distinct()


def flagged(samples: DataFrame, found: DataFrame, key: str, idx: str, name: str = "artifact") -> DataFrame:
    """Samples with a flag for those within an interval."""
    inside = indexes(found, key).select(F.col(key).alias("_k"), F.col("idx").alias("_i"), F.lit(True).alias(name))
    return samples.join(inside, (F.col(key) == F.col("_k")) & (F.col(idx) == F.col("_i")), "left").drop("_k", "_i").withColumn(name, F.coalesce(name, F.lit(False)))


def corrected_signal(y: np.ndarray, t: np.ndarray, found: pd.DataFrame, anchors: tuple[int, int], buffer: int, spikes: bool = True, jumps: bool = True) -> np.ndarray:
    """One recording: spikes are filled by a monotone cubic; the levels across jumps, measured after that, are taken off from each jump's end on, and the jumps are filled."""
    found = found.sort_values("start")
    return _mended(y, t, found["start"].tolist(), found["stop"].tolist(), found["type"].tolist(), anchors, buffer, spikes, jumps)


def _mended(y: np.ndarray, t: np.ndarray, start: list, stop: list, kind: list, anchors: tuple[int, int], buffer: int, spikes: bool, jumps: bool) -> np.ndarray:
    """As ``corrected_signal``, from intervals in order of their start; the time is that of the samples and of the intervals' surroundings."""
    y = np.array(y, float)
    n = len(y)

    def fill(some: list[tuple[int, int]]) -> None:
        for a, b in some:
            low, high = max(0, a - anchors[0]), min(n, b + anchors[1])
            y[low:high] = kernels.fill(y[low:high], t[low:high], a - low, b - low, *anchors)

    of = lambda name: [(int(a), int(b)) for a, b, k in zip(start, stop, kind, strict=True) if k == name]
    if spikes:
        fill(of("spike"))
    own = of("jump")
    if jumps and own:
        drift = np.zeros(n)
        for a, b in own:
            before, after = y[max(0, a - buffer + 1) : a + 1], y[b : b + buffer]
            if len(before) and len(after):
                drift[b] += np.median(after) - np.median(before)
        y -= np.cumsum(drift)
        fill(own)
    return y


def correct(samples: DataFrame, found: DataFrame, key: str, idx: str, t: str, value: str, anchors: tuple[int, int] = (4, 4), buffer: int = 100, spikes: bool = True, jumps: bool = True, name: str = "corrected") -> DataFrame:
    """``key, idx, t, <name>``: every sample, those of artifacts replaced.

    Intervals and samples go to the workers as one sorted stream, intervals of
    a recording first, so that a call to Python serves many recordings; of a
    recording that is not at its end a worker keeps the rows read so far.
    """
    kinds = {c: samples.schema[c].dataType.simpleString() for c in (key, idx, t)}
    a = samples.select(F.col(key).alias("key"), F.lit(1).alias("row"), F.col(idx).alias("at"), F.col(t).alias("t"), F.col(value).cast("double").alias("y"), F.lit(None).cast("long").alias("stop"), F.lit(None).cast("string").alias("type"))
    b = found.where("type is not null").select(F.col(key).cast(kinds[key]).alias("key"), F.lit(0).alias("row"), F.col("start").cast(kinds[idx]).alias("at"), F.lit(None).cast(kinds[t]).alias("t"), F.lit(None).cast("double").alias("y"), F.col("stop").cast("long").alias("stop"), "type")

    def floats(c) -> np.ndarray:
        return c.to_numpy(zero_copy_only=False).astype(float)

    def changes(c) -> np.ndarray:
        """Whether a key differs from the one before."""
        x, z = c[:-1], c[1:]
        same = pc.or_(pc.fill_null(pc.equal(x, z), False), pc.and_(pc.is_null(x), pc.is_null(z)))
        return ~same.to_numpy(zero_copy_only=False)

    def whole(some: list[pa.RecordBatch]) -> pa.RecordBatch:
        """Of whole recordings."""
        p = pa.Table.from_batches(some).combine_chunks()
        c = {k: p[k].combine_chunks() for k in p.column_names}
        c = {k: v.chunk(0) if isinstance(v, pa.ChunkedArray) else v for k, v in c.items()}
        is_sample = c["row"].to_numpy(zero_copy_only=False) == 1
        at, stop, y, time = c["at"].to_numpy(zero_copy_only=False), c["stop"].to_numpy(zero_copy_only=False), floats(c["y"]), floats(c["t"])
        first = np.concatenate([[0], np.flatnonzero(changes(c["key"])) + 1, [len(p)]])
        n_found = np.diff(np.concatenate([[0], np.cumsum(~is_sample)])[first])
        kind = c["type"].to_pylist() if n_found.any() else []
        for g in np.flatnonzero(n_found):
            low, mid, high = int(first[g]), int(first[g] + n_found[g]), int(first[g + 1])
            y[mid:high] = _mended(y[mid:high], time[mid:high], at[low:mid].tolist(), stop[low:mid].tolist(), kind[low:mid], anchors, buffer, spikes, jumps)
        keep = pa.array(is_sample)
        return pa.RecordBatch.from_arrays([c["key"].filter(keep), c["at"].filter(keep), c["t"].filter(keep), pa.array(y[is_sample])], names=[key, idx, t, name])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for p in batches:
            if not p.num_rows:
                continue
            of = p.column(p.schema.get_field_index("key"))
            last = pa.concat_arrays([held[-1].column(p.schema.get_field_index("key"))[-1:], of]) if held else of
            cut = np.flatnonzero(changes(last)) + (0 if held else 1)
            if len(cut):
                done = [*held, p.slice(0, int(cut[-1]))]
                held = []
                yield whole(done)
            held.append(p.slice(int(cut[-1])) if len(cut) else p)
        if held:
            yield whole(held)

    schema = ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + f", `{name}` double"
    # by a hash of the key: Spark leaves out a shuffle by the key that both sides of the union have gone through, but joins their partitions each in its own way
    return a.unionByName(b).repartition(F.xxhash64("key")).sortWithinPartitions("key", "row", F.col("at").asc_nulls_last()).mapInArrow(run, schema)


def preprocessed(samples: DataFrame, key: str, t: str, raw: str, reference: str | None = None, detector: Callable[[DataFrame], DataFrame] | None = None, corrector: Callable[[DataFrame, DataFrame], DataFrame] | None = None, **options) -> tuple[DataFrame, DataFrame | None]:
    """Preprocessing, then detection on the processed signal and correction: the samples (``key, idx, t, filtered, fitted_ref, processed``) and the intervals.

    The detector gets the processed samples, by default none runs; ``detect``
    fits with ``value="processed"`` and, for two channels,
    ``reference="fitted_ref"``.  The corrector gets samples and intervals and
    returns ``key, idx`` and ``corrected``, which replaces the signal.  Several
    steps read the processed samples: cache or write them if they are many.
    """
    out = preprocess(samples, key, t, raw, reference, **options)
    out = out.withColumn("idx", (F.row_number().over(Window.partitionBy(key).orderBy(t)) - 1).cast("long"))
    if detector is None:
        return out, None
    found = detector(out)
    if corrector is None:
        return out, found
    mended = corrector(out, found).select(F.col(key).alias("_of"), F.col("idx").alias("_i"), F.col("corrected").alias("_c"))
    out = out.join(mended, (F.col(key) == F.col("_of")) & (F.col("idx") == F.col("_i"))).withColumn("processed", F.col("_c")).drop("_of", "_i", "_c")
    return out, found
