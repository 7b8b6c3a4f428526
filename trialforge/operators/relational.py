"""Interval joins, nearest-time joins, islands and multiple-test adjustment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interval_join(left: DataFrame, right: DataFrame, key: str, low: str, high: str, at: str, width: float, how: str = "left") -> DataFrame:
    """Rows of ``right`` with ``low <= at <= high`` and equal ``key``; with ``how="left"`` one row of nulls for an interval that has none.

    Intervals are copied to the time buckets they touch and joined on (key,
    bucket), so one long recording spreads over many tasks; the exact bounds
    are the residual.  ``width`` should be near the usual interval length.
    Inverted intervals and those with a null bound match nothing.
    """
    bucket = lambda c: F.floor(c / width)
    touched = F.when(F.col(low) <= F.col(high), F.sequence(bucket(F.col(low)), bucket(F.col(high))))
    l = left.withColumn("_b", F.explode(touched)).alias("l")  # noqa: E741
    r = right.withColumn("_rb", bucket(F.col(at))).withColumnRenamed(key, "_rk").alias("r")
    on = (F.col(f"l.{key}") == F.col("_rk")) & (F.col("_b") == F.col("_rb")) & (F.col(f"r.{at}") >= F.col(f"l.{low}")) & (F.col(f"r.{at}") <= F.col(f"l.{high}"))
    inner = l.join(r, on).drop("_b", "_rb", "_rk")
    if how == "inner":
        return inner
    # whether an interval has a match depends on its key and bounds alone, and it meets a match in one bucket only
    some = inner.select(F.col(key).alias("_mk"), F.col(low).alias("_ml"), F.col(high).alias("_mh")).distinct()
    none = left.join(some, left[key].eqNullSafe(F.col("_mk")) & left[low].eqNullSafe(F.col("_ml")) & left[high].eqNullSafe(F.col("_mh")), "left_anti")
    return inner.unionByName(none, allowMissingColumns=True)


def pick(joined: DataFrame, by: list[str], at: str, rule: str, name: str) -> DataFrame:
    """One value per group: the first, last or mean time; null where nothing matched."""
    rules = {"first": F.min, "last": F.max, "mean": F.avg}
    if rule not in rules:
        raise ValueError(f"unknown rule {rule}")
    return joined.groupBy(*by).agg(rules[rule](at).alias(name))


def occurrences(joined: DataFrame, by: list[str], at: str, tie: str) -> DataFrame:
    """All matches in long form, numbered from 1 by time."""
    return joined.where(F.col(at).isNotNull()).withColumn("occurrence", F.row_number().over(Window.partitionBy(*by).orderBy(at, tie)))


def bracket(left: DataFrame, right: DataFrame, key: str, t: str, rt: str, *values: str) -> DataFrame:
    """The samples around each time: structs ``_p`` (the last at or before it) and ``_n`` (the first at or after it) of ``t`` and ``values``, null where there is none.

    One union sorted by time once in each direction, running from one end only,
    so a row costs the same whatever the distance.  Of samples at one time the
    least of the first value counts.
    """
    cols = [c for c in left.columns if c != key]
    sample = F.struct(F.col(rt).cast("double").alias("t"), *[F.col(v).alias(v) for v in values])
    b = right.where(F.col(rt).isNotNull()).select(key, F.col(rt).cast("double").alias("_t"), F.lit(0).alias("_k"), F.struct(*[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in cols]).alias("_row"), sample.alias("_s"))
    a = left.select(key, F.col(t).cast("double").alias("_t"), F.lit(1).alias("_k"), F.struct(*cols).alias("_row"), F.lit(None).cast(b.schema["_s"].dataType).alias("_s"))
    both = a.unionByName(b)
    whole = (Window.unboundedPreceding, Window.currentRow)
    tie = [F.col("_k"), F.col(f"_s.{values[0]}").desc()] if values else [F.col("_k")]
    back = F.last("_s", ignorenulls=True).over(Window.partitionBy(key).orderBy(F.col("_t").asc(), *tie).rowsBetween(*whole))
    ahead = F.last("_s", ignorenulls=True).over(Window.partitionBy(key).orderBy(F.col("_t").desc(), *tie).rowsBetween(*whole))
    return both.withColumn("_p", back).withColumn("_n", ahead).where("_k = 1").select(key, "_row.*", "_p", "_n")


def nearest(left: DataFrame, right: DataFrame, key: str, t: str, rt: str, rid: str) -> DataFrame:
    """Nearest sample of each time, ties to the earlier; outside the range the end sample, null for a null time.  Adds ``near`` (time) and ``near_id``."""
    out = bracket(left, right, key, t, rt, rid)
    use_left = F.col("_n").isNull() | (F.col("_p").isNotNull() & (F.col(t) - F.col("_p.t") <= F.col("_n.t") - F.col(t)))
    got = F.when(F.col(t).isNotNull(), F.when(use_left, F.col("_p")).otherwise(F.col("_n")))
    return out.select(key, *[c for c in left.columns if c != key], got["t"].alias("near"), got[rid].alias("near_id"))


def islands(frame: DataFrame, by: list[str], order: str, flag: Column) -> DataFrame:
    """Runs of rows where ``flag`` holds: rows with their ``island`` number (constant within a run of a group)."""
    w = Window.partitionBy(*by).orderBy(order)
    return frame.withColumn("_f", F.coalesce(flag, F.lit(False)).cast("int")).withColumn("island", F.col(order) - F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_f = 1").drop("_f")


def runs(frame: DataFrame, by: list[str], order: str, flag: Column) -> DataFrame:
    """``start, stop`` (inclusive) of every run."""
    return islands(frame, by, order, flag).groupBy(*by, "island").agg(F.min(order).alias("start"), F.max(order).alias("stop")).drop("island")


def merge_gaps(spans: DataFrame, by: list[str], gap: int) -> DataFrame:
    """Joins runs with at most ``gap`` rows between them."""
    w = Window.partitionBy(*by).orderBy("start")
    # the furthest stop so far, for overlapping spans
    far = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = (far.isNull() | (F.col("start") - far - 1 > gap)).cast("int")
    grouped = spans.withColumn("_c", cut).withColumn("_g", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*by, "_g").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_g")


def bh_adjust(frame: DataFrame, by: list[str], p: str, method: str = "bh") -> DataFrame:
    """Benjamini-Hochberg or -Yekutieli adjusted p-values in ``p_adj``, per group; null and NaN are no tests and stay null.

    Ranks and the running minimum each take one pass over a sorted group, which
    is one task's work.
    """
    if method not in ("bh", "by"):
        raise ValueError(f"unknown method {method}")
    w = Window.partitionBy(*by)
    own = F.when(~F.isnan(F.col(p).cast("double")), F.col(p).cast("double"))
    ranked = frame.withColumn("_p", own).withColumn("_r", F.row_number().over(w.orderBy(F.col("_p").asc_nulls_last()))).withColumn("_m", F.count("_p").over(w))
    if method == "by":
        ranked = ranked.withColumn("_m", F.col("_m") * F.sum(F.when(F.col("_p").isNotNull(), 1.0 / F.col("_r"))).over(w))
    raw = F.col("_p") * F.col("_m") / F.col("_r")
    low = F.min(raw).over(w.orderBy(F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ranked.withColumn("p_adj", F.when(F.col("_p").isNotNull(), F.least(F.lit(1.0), low))).drop("_r", "_m", "_p")
