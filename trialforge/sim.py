"""Closed-form layers of simulated recordings as Column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def time_base(spark: SparkSession, seconds: float, freq: float, t0: float = 0.0) -> DataFrame:
    return spark.range(round(seconds * freq)).select(F.col("id").alias("idx"), (F.col("id") / freq + t0).alias("t"))


def bleaching(t: Column, a1: float = 50.0, tau1: float = 300.0, a2: float = 20.0, tau2: float = 10_000.0, floor: float = 10.0) -> Column:
    return a1 * F.exp(-t / tau1) + a2 * F.exp(-t / tau2) + floor


def gamma_kernel(t: Column, amplitude: float = 0.02, k: float = 3.0, tau: float = 1.0) -> Column:
    """Peaks at (k - 1) tau with the given amplitude; zero before its onset."""
    return F.when(t >= 0, amplitude * F.pow(t / ((k - 1) * tau), F.lit(k - 1)) * F.exp((k - 1) - t / tau)).otherwise(0.0)


def alpha_kernel(t: Column, amplitude: float, tau: float) -> Column:
    return F.when(t >= 0, amplitude * (t / tau) * F.exp(1 - t / tau)).otherwise(0.0)


def exp_kernel(t: Column, amplitude: float, tau: float) -> Column:
    return F.when(t >= 0, amplitude * F.exp(-t / tau)).otherwise(0.0)


def gaussian_kernel(t: Column, amplitude: float, centre: float, sigma: float) -> Column:
    return amplitude * F.exp(-0.5 * F.pow((t - centre) / sigma, F.lit(2.0)))


def smootherstep(x: Column) -> Column:
    return x * x * x * (x * (x * 6 - 15) + 10)


def kernel_taps(spark: SparkSession, freq: float, kernel, cutoff: float = 1e-4, longest: float = 1000.0) -> int:
    """Samples of a kernel until it stays at or below ``cutoff`` of its peak; ValueError if it does not within ``longest`` seconds."""
    n = max(1, round(longest * freq))
    k = spark.range(n).select(F.col("id").alias("k"), F.abs(kernel(F.col("id") / freq)).alias("m"))
    top = k.agg(F.max_by(F.struct("k", "m"), F.struct("m", -F.col("k"))).alias("top")).first().top
    if top.m == 0:
        return 1
    last = k.where((F.col("k") >= top.k) & (F.col("m") > cutoff * top.m)).agg(F.max("k")).first()[0]
    if last == n - 1:
        raise ValueError(f"the kernel does not decay to {cutoff} of its peak in {longest} s")
    return last + 1


def event_layer(samples: DataFrame, onsets: list[float], freq: float, taps: int | None, kernel) -> DataFrame:
    """Sum of kernels at onsets: each onset (snapped to the sample at or after it) adds ``taps`` values, or with None those of ``kernel_taps``; only touched samples are aggregated."""
    spark = samples.sparkSession
    taps = kernel_taps(spark, freq, kernel) if taps is None else taps
    starts = spark.createDataFrame([(float(o),) for o in onsets], "onset double").select(F.ceil(F.col("onset") * freq).alias("first"))
    each = starts.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(taps - 1)))).select((F.col("first") + F.col("k")).alias("idx"), kernel(F.col("k") / freq).alias("v"))
    return samples.join(each.groupBy("idx").agg(F.sum("v").alias("event")), "idx", "left").withColumn("event", F.coalesce("event", F.lit(0.0)))


def composed(base: Column, floor: float, event: Column, noise: Column, artifact: Column) -> Column:
    """clean = (B - floor) (E + D) + B, times the artifacts, plus noise."""
    return ((base - floor) * event + base) * artifact + noise


def double_exp_kernel(t: Column, amplitude: float, rise: float, decay: float) -> Column:
    """Difference of two exponentials, scaled to its peak."""
    top = math.log(decay / rise) * rise * decay / (decay - rise)
    scale = amplitude / (math.exp(-top / decay) - math.exp(-top / rise))
    return F.when(t >= 0, scale * (F.exp(-t / decay) - F.exp(-t / rise))).otherwise(0.0)


def smooth_trapezoid_kernel(t: Column, amplitude: float, rise: float, hold: float, fall: float) -> Column:
    """Smooth rise, plateau and smooth fall."""
    up, down = smootherstep(t / rise), smootherstep((rise + hold + fall - t) / fall)
    shape = F.when(t < 0, 0.0).when(t < rise, up).when(t < rise + hold, 1.0).when(t < rise + hold + fall, down).otherwise(0.0)
    return amplitude * shape


def half_hann(x: Column) -> Column:
    """Rises from 0 at x = 0 to 1 at x = 1."""
    y = F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    return 0.5 * (1 - F.cos(math.pi * y))
