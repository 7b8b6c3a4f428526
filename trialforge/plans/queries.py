"""Query catalogue over the driver's tables: each query with the SQL it must equal.

``events`` are recordings (one per user: samples in time order with a label and
a value), ``embeddings`` are trials of 64 points, ``lineitem`` two-channel
samples and observation tables.  Computed doubles are rounded alike on both
sides.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sim
from ..functions import vec
from ..kernels import signal as kernels
from ..operators import comparison, peaks, recording, relational, trials, windowing
from ..sources import sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def samples(spark: SparkSession, d: str) -> DataFrame:
    return recording.samples(read(spark, d, "events"))


def matrix(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


def r(c: str | Column, n: int = 6) -> Column:
    """As the SQL rounds: the double times 10^n, halves away from zero (Spark's ``round`` goes by the decimal text, which differs near a half)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c * F.lit(10.0**n)) / F.lit(10.0**n) + F.lit(0.0)


# SQL of the shared inputs
S = "WITH s AS (SELECT event_id, user_id, event_type, value, ts, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 AS t, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::BIGINT AS idx FROM events)"
X = "WITH x AS (SELECT vec_id, label, list_transform(embedding, lambda e: e::DOUBLE) AS x FROM embeddings)"
L = X + ", l AS (SELECT vec_id, label, (i - 1)::INTEGER AS time_idx, x[i] AS v FROM (SELECT *, unnest(range(1, 65)) AS i FROM x))"


# -- recordings ---------------------------------------------------------------


@query(S + " SELECT user_id, round((count(*) - 1) / (max(t) - min(t)), 9) + 0.0 AS frequency, count(*) AS n_samples, min(t) AS t_min, max(t) AS t_max FROM s GROUP BY user_id")
def recording_frequency(spark, d):
    f = recording.frequency(samples(spark, d), "user_id")
    return f.select("user_id", r("frequency", 9).alias("frequency"), "n_samples", "t_min", "t_max")


@query(S + ", m AS (SELECT user_id, avg(value) AS m, stddev_pop(value) AS sd FROM s GROUP BY user_id) SELECT event_id, round((value - m) / sd, 6) + 0.0 AS z FROM s JOIN m USING (user_id)")
def signal_zscore(spark, d):
    return recording.normalised(samples(spark, d), "user_id", "value").select("event_id", r("normalised").alias("z"))


@query(S + ", m AS (SELECT user_id, stddev_pop(value) AS sd FROM s GROUP BY user_id) SELECT event_id, round(value / sd, 6) + 0.0 AS z FROM s JOIN m USING (user_id)")
def signal_nullz(spark, d):
    return recording.normalised(samples(spark, d), "user_id", "value", "nullZ").select("event_id", r("normalised").alias("z"))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice - l_quantity, 4) + 0.0 AS df, round((l_extendedprice - l_quantity) / greatest(l_quantity, 1.1920928955078125e-07), 9) + 0.0 AS dff FROM lineitem")
def correct_df_dff(spark, d):
    y, x = F.col("l_extendedprice"), F.col("l_quantity")
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r(recording.corrected(y, x, "dF"), 4).alias("df"), r(recording.corrected(y, x, "dF/F"), 9).alias("dff"))


@query("SELECT l_suppkey, round(regr_slope(l_extendedprice, l_quantity), 4) + 0.0 AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) + 0.0 AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) + 0.0 AS r2, count(*) AS n FROM lineitem GROUP BY l_suppkey")
def ols_reference(spark, d):
    o = recording.ols(read(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice", "l_quantity")
    return o.select("l_suppkey", r("slope", 4).alias("slope"), r("intercept", 3).alias("intercept"), r("r2").alias("r2"), "n")


@query("SELECT l_suppkey, round(sum(l_quantity * l_extendedprice) / sum(l_quantity * l_quantity), 4) + 0.0 AS slope, count(*) AS n FROM lineitem GROUP BY l_suppkey")
def ols_no_intercept(spark, d):
    o = recording.ols(read(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice", "l_quantity", intercept=False)
    return o.select("l_suppkey", r("slope", 4).alias("slope"), "n")


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_suppkey) AS c FROM lineitem),
p AS (SELECT *, (CASE WHEN i < (c % 4) * (c // 4 + 1) THEN i // (c // 4 + 1) ELSE (c % 4) + (i - (c % 4) * (c // 4 + 1)) // (c // 4) END)::INTEGER AS piece FROM o)
SELECT l_suppkey, piece, round(regr_slope(l_extendedprice, l_quantity), 3) + 0.0 AS slope, count(*) AS n FROM p GROUP BY l_suppkey, piece""")
def windowed_ols(spark, d):
    from pyspark.sql import Window

    o = read(spark, d, "lineitem").withColumn("i", F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")) - 1)
    o = recording.pieces(o, "l_suppkey", "i", 4)
    return recording.ols(o, ["l_suppkey", "piece"], "l_extendedprice", "l_quantity").select("l_suppkey", "piece", r("slope", 3).alias("slope"), "n")


@query(S + ", m AS (SELECT user_id, median(value) AS med FROM s GROUP BY user_id), a AS (SELECT s.user_id, 1.4826 * median(abs(value - med)) AS mad FROM s JOIN m USING (user_id) GROUP BY s.user_id) SELECT event_id, round(med, 6) + 0.0 AS med, round(mad, 6) + 0.0 AS mad, round(0.6745 * (value - med) / mad, 6) + 0.0 AS score FROM s JOIN m USING (user_id) JOIN a USING (user_id)")
def mad_score(spark, d):
    return recording.mad_scores(samples(spark, d), ["user_id"], "value").select("event_id", r("med").alias("med"), r("mad").alias("mad"), r("score").alias("score"))


@query(S + ", a AS (SELECT *, coalesce(value - lag(value) OVER (PARTITION BY user_id ORDER BY idx), 0) AS d1 FROM s) SELECT event_id, round(d1, 6) + 0.0 AS d1, round(coalesce(d1 - lag(d1) OVER (PARTITION BY user_id ORDER BY idx), 0), 6) + 0.0 AS d2 FROM a")
def difference(spark, d):
    one = recording.difference(samples(spark, d), ["user_id"], "idx", "value").withColumnRenamed("diff", "d1")
    return recording.difference(one, ["user_id"], "idx", "d1").select("event_id", r("d1").alias("d1"), r("diff").alias("d2"))


@query(S + " SELECT user_id, (idx // 10)::BIGINT AS block, round(avg(value), 6) + 0.0 AS value, round(avg(t), 4) + 0.0 AS t FROM s GROUP BY ALL HAVING count(*) = 10".replace("GROUP BY ALL", "GROUP BY user_id, idx // 10"))
def downsample_mean(spark, d):
    return recording.downsample_mean(samples(spark, d), "user_id", "idx", 10, "value", "t").select("user_id", "block", r("value").alias("value"), r("t", 4).alias("t"))


@query(S + " SELECT event_id, user_id, idx FROM s WHERE idx >= 5 AND idx < 15")
def trim_index(spark, d):
    return recording.trim_index(samples(spark, d), 5, 15).select("event_id", "user_id", "idx")


@query(S + " SELECT event_id, user_id, t FROM s WHERE t BETWEEN 86400 AND 864000")
def trim_time(spark, d):
    return recording.trim_time(samples(spark, d), 86400.0, 864000.0).select("event_id", "user_id", "t")


@query("SELECT event_type, count(*) AS n FROM (SELECT event_type FROM events UNION ALL SELECT 'engaged' FROM events WHERE event_type IN ('click', 'purchase')) GROUP BY event_type")
def merge_events(spark, d):
    return trials.value_counts(recording.merge_events(read(spark, d, "events"), ["click", "purchase"], "engaged", drop=False), "event_type")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def value_counts(spark, d):
    return trials.value_counts(read(spark, d, "events"), "event_type")


@query(S + ", w AS (SELECT user_id, unnest(range(greatest(ceil((idx - 7) / 4.0)::BIGINT, 0), idx // 4 + 1)) AS w, value FROM s) SELECT user_id, w::BIGINT AS w, round(median(value), 6) + 0.0 AS med FROM w GROUP BY user_id, w HAVING count(*) = 8")
def strided_median(spark, d):
    return recording.strided_medians(samples(spark, d), "user_id", "idx", "value", 8).select("user_id", "w", r("med").alias("med"))


@query(S + ", a AS (SELECT event_id, quantile_cont(value, 0.5) OVER k AS m, avg(value) OVER k AS a, stddev_pop(value) OVER k AS sd, count(*) OVER k AS n FROM s WINDOW k AS (PARTITION BY user_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) SELECT event_id, round(m, 6) + 0.0 AS roll_median, round(a, 6) + 0.0 AS roll_mean, round(sd, 5) + 0.0 AS roll_std FROM a WHERE n = 5")
def rolling_interior(spark, d):
    return recording.rolling(samples(spark, d), "user_id", "idx", "value", 2).select("event_id", r("roll_median").alias("roll_median"), r("roll_mean").alias("roll_mean"), r("roll_std", 5).alias("roll_std"))


@query("""WITH a AS (SELECT l_suppkey, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2 AS x,
rank() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_suppkey, l_extendedprice) - 1) / 2 AS y FROM lineitem)
SELECT l_suppkey, round(corr(x, y), 6) + 0.0 AS rho, count(*) AS n FROM a GROUP BY l_suppkey""")
def spearman_by_group(spark, d):
    rows = read(spark, d, "lineitem")
    return recording.spearman(rows, ["l_suppkey"], "l_quantity", "l_extendedprice", recording.tasks_for(rows)).select("l_suppkey", r("rho").alias("rho"), "n")


_TRACES = ["l_quantity", "l_extendedprice", "l_discount"]


@query("SELECT l_orderkey, l_linenumber, source, value FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount FROM lineitem) UNPIVOT INCLUDE NULLS (value FOR source IN (l_quantity, l_extendedprice, l_discount))")
def unpivot_traces(spark, d):
    return sinks.long(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], _TRACES)


# -- events and trials ----------------------------------------------------------


def _align(spark, d, labels):
    return windowing.alignments(samples(spark, d), labels)


@query(S + ", p AS (SELECT user_id, t FROM s WHERE event_type = 'purchase'), j AS (SELECT p.user_id, p.t AS c, s.t - p.t AS rel, s.value FROM p JOIN s ON s.user_id = p.user_id AND s.t BETWEEN p.t - 86400 AND p.t + 86400), b AS (SELECT user_id, c, avg(value) AS base FROM j WHERE rel < 0 GROUP BY user_id, c) SELECT floor(rel / 7200)::BIGINT AS bin, round(avg(value - base), 4) + 0.0 AS mean, round(stddev_pop(value - base), 4) + 0.0 AS std, count(*) AS n FROM j JOIN b ON j.user_id = b.user_id AND j.c = b.c GROUP BY 1")
def event_aligned_mean(spark, d):
    s = samples(spark, d)
    a = windowing.alignments(s, ["purchase"]).withColumn("lo", F.col("align_t") - 86400).withColumn("hi", F.col("align_t") + 86400)
    j = relational.interval_join(a, s.select("user_id", F.col("t").alias("st"), "value"), "user_id", "lo", "hi", "st", 172800.0, "inner").withColumn("rel", F.col("st") - F.col("align_t"))
    from pyspark.sql import Window

    base = F.avg(F.when(F.col("rel") < 0, F.col("value"))).over(Window.partitionBy("user_id", "align_t"))
    j = j.withColumn("v", F.col("value") - base).where("v is not null")
    return j.groupBy(F.floor(F.col("rel") / 7200).alias("bin")).agg(r(F.avg("v"), 4).alias("mean"), r(F.stddev_pop("v"), 4).alias("std"), F.count("*").alias("n"))


@query(S + " SELECT user_id, event_type AS align_event, t AS align_t, (row_number() OVER (PARTITION BY user_id ORDER BY t, CASE event_type WHEN 'purchase' THEN 1 ELSE 2 END, event_id) - 1)::BIGINT AS trial_ord FROM s WHERE event_type IN ('purchase', 'click')")
def align_multi_label_stable(spark, d):
    return _align(spark, d, ["purchase", "click"])


_J = S + ", p AS (SELECT user_id, t, (row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1)::BIGINT AS trial_ord FROM s WHERE event_type = 'purchase'), j AS (SELECT p.user_id, trial_ord, s.event_type AS label, s.t AS ev, s.event_id FROM p JOIN s ON s.user_id = p.user_id AND ((s.event_type = 'click' AND s.t BETWEEN p.t AND p.t + 172800) OR (s.event_type = 'view' AND s.t BETWEEN p.t - 86400 AND p.t + 86400)))"
_TOL = {"click": (0.0, 172800.0), "view": (-86400.0, 86400.0)}


def _annotated(rule: str, f: str) -> None:
    def run(spark, d, rule=rule):
        s = samples(spark, d)
        return windowing.annotate(windowing.alignments(s, ["purchase"]), s, _TOL, rule=rule).select("user_id", "trial_ord", "label", r("ev_t", 4).alias("ev_t"))

    run.__name__ = f"annotate_{rule}"
    query(_J + f" SELECT user_id, trial_ord, label, round({f}(ev), 4) + 0.0 AS ev_t FROM j GROUP BY user_id, trial_ord, label")(run)


for _rule, _f in (("first", "min"), ("last", "max"), ("mean", "avg")):
    _annotated(_rule, _f)


@query(_J + " SELECT user_id, trial_ord, label, row_number() OVER (PARTITION BY user_id, trial_ord, label ORDER BY ev, event_id)::INTEGER AS occurrence, ev AS ev_t FROM j")
def annotate_all_occurrences(spark, d):
    s = samples(spark, d)
    return windowing.annotate(windowing.alignments(s, ["purchase"]), s, _TOL, rule="all")


@query(_J + ", c AS (SELECT user_id, trial_ord, min(ev) FILTER (label = 'click') AS c, min(ev) FILTER (label = 'view') AS v FROM j GROUP BY user_id, trial_ord) SELECT p.user_id, p.trial_ord, coalesce(v, c, p.t) AS center_t, ((c IS NOT NULL)::INTEGER + (v IS NOT NULL)::INTEGER) AS n_centers FROM p LEFT JOIN c ON p.user_id = c.user_id AND p.trial_ord = c.trial_ord")
def center_on_last_wins(spark, d):
    s = samples(spark, d)
    a = windowing.alignments(s, ["purchase"])
    out = windowing.centred(a, windowing.annotate(a, s, _TOL), ["click", "view"])
    return out.select("user_id", "trial_ord", "center_t", "n_centers")


@query(S + ", p AS (SELECT event_id, user_id, t + 1800 AS q FROM s WHERE event_type = 'purchase'), j AS (SELECT p.event_id, s.t AS near, s.idx AS near_id, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(s.t - q), s.t) AS k FROM p JOIN s ON s.user_id = p.user_id) SELECT event_id, near, near_id FROM j WHERE k = 1")
def nearest_snap(spark, d):
    s = samples(spark, d)
    a = s.where("event_type = 'purchase'").select("user_id", "event_id", (F.col("t") + 1800).alias("q"))
    return relational.nearest(a, s, "user_id", "q", "t", "idx").select("event_id", "near", "near_id")


@query(S + ", p AS (SELECT event_id, user_id, t + 1800 AS q FROM s WHERE event_type = 'purchase'), j AS (SELECT p.user_id, s.idx, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(s.t - q), s.t) AS k FROM p JOIN s ON s.user_id = p.user_id), f AS (SELECT DISTINCT user_id, idx FROM j WHERE k = 1) SELECT s.event_id, f.idx IS NOT NULL AS flag FROM s LEFT JOIN f ON s.user_id = f.user_id AND s.idx = f.idx")
def nearest_event_mask(spark, d):
    s = samples(spark, d)
    a = s.where("event_type = 'purchase'").select("user_id", "event_id", (F.col("t") + 1800).alias("q"))
    f = relational.nearest(a, s, "user_id", "q", "t", "idx").select("user_id", F.col("near_id").alias("idx")).distinct().withColumn("flag", F.lit(True))
    return s.join(f, ["user_id", "idx"], "left").select("event_id", F.coalesce("flag", F.lit(False)).alias("flag"))


@query(S + ", n AS (SELECT user_id, max(idx) AS last FROM s GROUP BY user_id), p AS (SELECT s.user_id, idx AS c FROM s JOIN n USING (user_id) WHERE event_type = 'purchase' AND idx >= 3 AND idx + 3 <= last) SELECT p.user_id, p.c AS center_idx, (s.idx - p.c + 3)::INTEGER AS time_idx, s.value AS signal FROM p JOIN s ON s.user_id = p.user_id AND s.idx BETWEEN p.c - 3 AND p.c + 3")
def window_nearest_idx(spark, d):
    s = samples(spark, d)
    t = s.where("event_type = 'purchase'").select("user_id", F.col("idx").alias("center_idx"))
    return windowing.extract_trials(s, t, (-3, 4)).select("user_id", "center_idx", "time_idx", "signal")


# -- trial matrices --------------------------------------------------------------


@query(L + " SELECT label, time_idx, round(avg(v), 6) + 0.0 AS mean, round(stddev_pop(v), 6) + 0.0 AS std, round(stddev_pop(v) / sqrt(count(*)), 6) + 0.0 AS sem, count(*) AS n FROM l GROUP BY label, time_idx")
def collapse_group(spark, d):
    c = trials.collapse(matrix(spark, d), ["label"])
    return c.select("label", "time_idx", r("mean").alias("mean"), r("std").alias("std"), r("sem").alias("sem"), "n")


@query(L + " SELECT time_idx, round(avg(v), 6) + 0.0 AS mean, round(stddev_pop(v), 6) + 0.0 AS std, count(*) AS n FROM l GROUP BY time_idx")
def collapse_global(spark, d):
    c = trials.collapse(matrix(spark, d), [])
    return c.select("time_idx", r("mean").alias("mean"), r("std").alias("std"), "n")


@query("SELECT label, md5(string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id)) AS ids, count(*) AS n FROM embeddings GROUP BY label")
def collapse_list(spark, d):
    c = trials.collapse_lists(matrix(spark, d), ["label"], "vec_id")
    return c.select("label", F.md5(F.array_join(F.col("vec_id").cast("array<string>"), ",")).alias("ids"), "n")


_NORM = {
    "zscore": "list_transform(x, lambda v: (v - list_avg(x[1:16])) / list_stddev_pop(x[1:16]))",
    "zero": "list_transform(x, lambda v: v - list_avg(x[1:16]))",
    "mad": "list_transform(x, lambda v: (v - list_median(x[1:16])) / (1.4826 * list_median(list_transform(x[1:16], lambda w: abs(w - list_median(x[1:16]))))))",
    "amp": "list_transform(x, lambda v: (v - list_avg(x[1:16])) / list_max(list_transform(x, lambda w: abs(w - list_avg(x[1:16])))))",
}


def _normalised(how: str, sql: str) -> None:
    def run(spark, d, how=how):
        n = trials.normalised(matrix(spark, d), how, F.slice("x", 1, 16))
        return trials.to_long(n, ["vec_id"]).select("vec_id", "time_idx", r("signal", 5).alias("signal"))

    run.__name__ = f"trial_{how}"
    query(X + f", y AS (SELECT vec_id, {sql} AS y FROM x) SELECT vec_id, (i - 1)::INTEGER AS time_idx, round(y[i], 5) + 0.0 AS signal FROM (SELECT *, unnest(range(1, 65)) AS i FROM y)")(run)


for _how, _sql in _NORM.items():
    _normalised(_how, _sql)


@query(L + " SELECT vec_id, time_idx, v AS signal FROM l")
def to_long(spark, d):
    return trials.to_long(matrix(spark, d), ["vec_id"])


@query("SELECT vec_id, label FROM embeddings WHERE label = 3")
def filter_trials(spark, d):
    return trials.filter_rows(matrix(spark, d), F.col("label") == 3).select("vec_id", "label")


@query(X + " SELECT vec_id, label, " + ", ".join(f"x[{k}] AS t_{k}" for k in range(1, 65)) + " FROM x")
def to_wide(spark, d):
    return trials.to_wide(matrix(spark, d), ["vec_id", "label"])


@query(X + ", a AS (SELECT vec_id, list_sum(list_transform(range(1, 64), lambda i: (x[i] + x[i + 1]) / 2)) AS a, list_sum(list_transform(range(17, 32), lambda i: (x[i] + x[i + 1]) / 2)) AS b, list_sum(list_transform(range(1, 64), lambda i: (greatest(x[i], 0) + greatest(x[i + 1], 0)) / 2)) AS c FROM x) SELECT vec_id, round(a, 6) + 0.0 AS auc_full, round(b, 6) + 0.0 AS auc_window, round(c, 6) + 0.0 AS auc_positive FROM a")
def area_under_curve(spark, d):
    t = matrix(spark, d)
    positive = F.transform("x", lambda v: F.greatest(v, F.lit(0.0)))
    return t.select("vec_id", r(vec.trapezoid(F.col("x"))).alias("auc_full"), r(vec.trapezoid(F.slice("x", 17, 16))).alias("auc_window"), r(vec.trapezoid(positive)).alias("auc_positive"))


@query(L + ", b AS (SELECT vec_id, time_idx // 5 AS b, avg(v) AS v, count(*) AS n FROM l GROUP BY vec_id, time_idx // 5) SELECT vec_id, b::INTEGER AS time_idx, round(v, 6) + 0.0 AS signal FROM b WHERE n = 5")
def trial_downsample(spark, d):
    return trials.to_long(trials.downsample(matrix(spark, d), 5), ["vec_id"]).select("vec_id", "time_idx", r("signal").alias("signal"))


@query(L + ", a AS (SELECT vec_id, time_idx, coalesce(v - lag(v) OVER (PARTITION BY vec_id ORDER BY time_idx), 0) AS d FROM l) SELECT vec_id, time_idx, round(coalesce(d - lag(d) OVER (PARTITION BY vec_id ORDER BY time_idx), 0), 6) + 0.0 AS signal FROM a")
def trial_difference(spark, d):
    t = matrix(spark, d).withColumn("x", vec.difference(F.col("x"), 1))
    t = t.withColumn("x", vec.difference(F.col("x"), 1))
    return trials.to_long(t, ["vec_id"]).select("vec_id", "time_idx", r("signal").alias("signal"))


@query(L + " SELECT l.vec_id, (time_idx - c + 5)::INTEGER AS time_idx, v AS signal FROM l JOIN (SELECT vec_id, vec_id % 64 AS c FROM embeddings) USING (vec_id) WHERE c - 5 >= 0 AND c + 5 <= 63 AND time_idx BETWEEN c - 5 AND c + 5")
def rewindow_drop_invalid(spark, d):
    t = trials.rewindow(matrix(spark, d), (F.col("vec_id") % 64).cast("double"), (-5.0, 6.0), 1.0, 64)
    return trials.to_long(t, ["vec_id"])


@query(X + ", p AS (SELECT vec_id, x, 20.0 + (vec_id % 10) / 10.0 AS c FROM x), q AS (SELECT vec_id, x, k, c - 4 + k / 2.0 AS pos FROM (SELECT *, unnest(range(0, 16)) AS k FROM p)) SELECT vec_id, k::INTEGER AS time_idx, round(x[floor(pos)::INT + 1] + (x[floor(pos)::INT + 2] - x[floor(pos)::INT + 1]) * (pos - floor(pos)), 6) + 0.0 AS signal FROM q")
def window_interp(spark, d):
    own = matrix(spark, d)
    centre = 20.0 + (F.col("vec_id") % 10) / 10.0
    at = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: centre - 4 + k / 2.0)
    return trials.to_long(own.withColumn("x", vec.interpolate(F.col("x"), at)), ["vec_id"]).select("vec_id", "time_idx", r("signal").alias("signal"))


@query("SELECT vec_id, label * 2 AS twice, 'label: ' || label AS name FROM embeddings WHERE label < 5 UNION ALL SELECT vec_id, label * 2, NULL FROM embeddings WHERE label >= 5")
def union_trials_outer(spark, d):
    t = trials.mutate(matrix(spark, d), twice=lambda f: f["label"] * 2)
    a = trials.labels(t.where("label < 5").withColumn("k", F.col("label")), ["label"]).select("vec_id", "twice", F.col("label").alias("name"))
    return trials.union_trials(a, t.where("label >= 5").select("vec_id", "twice"), "outer")


@query("SELECT vec_id, label FROM embeddings WHERE label < 3 UNION ALL SELECT vec_id, label FROM embeddings WHERE label >= 3")
def union_trials_inner(spark, d):
    t = matrix(spark, d)
    return trials.union_trials(t.where("label < 3").select("vec_id", "label"), t.where("label >= 3").select("vec_id", "label", F.lit(1).alias("extra")))


# -- peaks and artifacts ------------------------------------------------------------

_M = X + ", b AS (SELECT *, list_median(x) AS med FROM x), c AS (SELECT *, 1.4826 * list_median(list_transform(x, lambda w: abs(w - med))) AS mad FROM b), f AS (SELECT vec_id, med, sign, i - 1 AS i, x[i] AS v, sign * (x[i] - med) > 1.5 * mad AS flag FROM (SELECT *, unnest([1, -1]) AS sign FROM (SELECT *, unnest(range(1, 65)) AS i FROM c))), g AS (SELECT *, i - row_number() OVER (PARTITION BY vec_id, sign ORDER BY i) AS k FROM f WHERE flag), u AS (SELECT vec_id, sign, med, min(i) AS start, max(i) AS stop FROM g GROUP BY vec_id, sign, med, k)"
_G = _M + ", h AS (SELECT *, start - max(stop) OVER w - 1 AS gap FROM u WINDOW w AS (PARTITION BY vec_id, sign ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), m AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY vec_id, sign ORDER BY start) AS k FROM h), z AS (SELECT vec_id, sign, med, min(start) AS start, max(stop) AS stop FROM m GROUP BY vec_id, sign, med, k)"
_DIR = "CASE WHEN sign > 0 THEN 'positive' ELSE 'negative' END AS direction"


def _found(spark, d):
    return peaks.threshold_runs(matrix(spark, d), "vec_id", threshold=1.5)


@query(_M + f" SELECT vec_id, {_DIR}, start::INTEGER AS start, stop::INTEGER AS stop FROM u")
def threshold_peaks_static(spark, d):
    return _found(spark, d).select("vec_id", "direction", "start", "stop")


@query(_G + f" SELECT vec_id, {_DIR}, start::INTEGER AS start, stop::INTEGER AS stop FROM z")
def peaks_merge_close(spark, d):
    return peaks.merged_close(_found(spark, d), "vec_id", 2).select("vec_id", "direction", "start", "stop")


@query(_G + f" SELECT vec_id, {_DIR}, start::INTEGER AS start, stop::INTEGER AS stop FROM z WHERE stop - start + 1 BETWEEN 2 AND 6")
def peaks_size_filter(spark, d):
    return peaks.sized(peaks.merged_close(_found(spark, d), "vec_id", 2), 2, 6).select("vec_id", "direction", "start", "stop")


_P = _G + f", y AS (SELECT z.*, list_transform(x[start + 1 : stop + 1], lambda v: v - med) AS y FROM z JOIN x USING (vec_id)), a AS (SELECT *, list_transform(y, lambda v: sign * v) AS q FROM y), e AS (SELECT *, list_position(q, list_max(q)) AS p FROM a), pk AS (SELECT vec_id, {_DIR}, start::INTEGER AS start, stop::INTEGER AS stop, (start + p - 1)::INTEGER AS peak_idx, y[p] AS height, least(y[p] - y[1], y[p] - y[-1]) AS prominence, (stop - start)::DOUBLE AS duration, coalesce(list_sum(list_transform(range(1, len(y)), lambda i: (y[i] + y[i + 1]) / 2)), 0) AS area FROM e)"


def _metrics(spark, d):
    return peaks.metrics(peaks.merged_close(_found(spark, d), "vec_id", 2), matrix(spark, d), "vec_id")


@query(_P + " SELECT vec_id, direction, start, stop, peak_idx, round(height, 6) + 0.0 AS height, round(prominence, 6) + 0.0 AS prominence, duration, round(area, 6) + 0.0 AS area FROM pk")
def peak_metrics(spark, d):
    return _metrics(spark, d).select("vec_id", "direction", "start", "stop", "peak_idx", r("height").alias("height"), r("prominence").alias("prominence"), "duration", r("area").alias("area"))


def _filtered(how: str, sql: str, value=None) -> None:
    def run(spark, d, how=how, value=value):
        return peaks.filter_peaks(_metrics(spark, d), "vec_id", "duration", how, value).select("vec_id", "direction", "start", "duration")

    run.__name__ = f"peak_filter_{how}"
    query(_P + sql)(run)


_filtered("lowest", " SELECT vec_id, direction, start, duration FROM (SELECT *, min(duration) OVER (PARTITION BY vec_id) AS b FROM pk) WHERE duration = b")
_filtered("highest", " SELECT vec_id, direction, start, duration FROM (SELECT *, max(duration) OVER (PARTITION BY vec_id) AS b FROM pk) WHERE duration = b")
_filtered("closest", " SELECT vec_id, direction, start, duration FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(duration - 2.0), start) AS k FROM pk) WHERE k = 1", 2.0)
_filtered("between", " SELECT vec_id, direction, start, duration FROM pk WHERE duration BETWEEN 1.0 AND 3.0", (1.0, 3.0))
_filtered("equals", " SELECT vec_id, direction, start, duration FROM pk WHERE duration = 1.0", 1.0)

_A = S + ", d AS (SELECT *, coalesce(value - lag(value) OVER (PARTITION BY user_id ORDER BY idx), 0) AS d FROM s), dm AS (SELECT user_id, median(d) AS med FROM d GROUP BY user_id), da AS (SELECT d.user_id, 1.4826 * median(abs(d - med)) AS mad FROM d JOIN dm USING (user_id) GROUP BY d.user_id), o AS (SELECT d.user_id, idx FROM d JOIN dm USING (user_id) JOIN da USING (user_id) WHERE abs(0.6745 * (d - med) / mad) > 2), k AS (SELECT user_id, idx, idx - row_number() OVER (PARTITION BY user_id ORDER BY idx) AS k FROM o), u AS (SELECT user_id, min(idx) - 1 AS start, max(idx) + 1 AS stop FROM k GROUP BY user_id, k), h AS (SELECT *, start - max(stop) OVER (PARTITION BY user_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1 AS gap FROM u), m AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start) AS g FROM h), n AS (SELECT user_id, max(idx) AS last FROM s GROUP BY user_id), iv AS (SELECT user_id, greatest(min(start), 0)::BIGINT AS start, (least(max(stop), any_value(last)) + 1)::BIGINT AS stop FROM m JOIN n USING (user_id) GROUP BY user_id, g)"
_AM = _A + ", nr AS (SELECT iv.user_id, start, stop, idx, t, value FROM iv JOIN s ON s.user_id = iv.user_id AND idx > start - 5 AND idx < stop + 5), bf AS (SELECT user_id, start, stop, median(value) FILTER (idx <= start) AS before, median(value) FILTER (idx >= stop) AS after, max(t) FILTER (idx = start) AS t0, max(t) FILTER (idx <= stop) AS t1 FROM nr GROUP BY user_id, start, stop), am AS (SELECT nr.user_id, nr.start, nr.stop, arg_max(value - before, (abs(value - before), -idx)) AS amp FROM nr JOIN bf ON nr.user_id = bf.user_id AND nr.start = bf.start WHERE idx >= nr.start AND idx < nr.stop GROUP BY nr.user_id, nr.start, nr.stop), af AS (SELECT bf.*, amp FROM bf JOIN am ON bf.user_id = am.user_id AND bf.start = am.start)"


def _artifacts(spark, d):
    s = recording.difference(samples(spark, d), ["user_id"], "idx", "value")
    scored = recording.mad_scores(s, ["user_id"], "diff")
    found = peaks.artifact_intervals(scored, "user_id", "idx", "score", 2.0, 1, 1)
    return s, found


@query(_A + " SELECT user_id, start, stop FROM iv")
def artifact_intervals(spark, d):
    return _artifacts(spark, d)[1]


@query(_AM + " SELECT user_id, start, stop, round(before, 6) + 0.0 AS before, round(after - before, 6) + 0.0 AS baseline_change, round(amp, 6) + 0.0 AS amplitude, round(t1 - t0, 4) + 0.0 AS duration FROM af")
def artifact_metrics(spark, d):
    s, found = _artifacts(spark, d)
    m = peaks.artifact_metrics(found, s, "user_id", "idx", "t", "value", 5)
    return m.select("user_id", "start", "stop", r("before").alias("before"), r("baseline_change").alias("baseline_change"), r("amplitude").alias("amplitude"), r("duration", 4).alias("duration"))


@query(_AM + " SELECT user_id, round(sum(ln(abs(amp) + 1) * (t1 - t0)), 2) + 0.0 AS artifact_score, count(*) AS n FROM af GROUP BY user_id")
def artifact_score(spark, d):
    s, found = _artifacts(spark, d)
    return peaks.artifact_score(peaks.artifact_metrics(found, s, "user_id", "idx", "t", "value", 5), "user_id").select("user_id", r("artifact_score", 2).alias("artifact_score"), "n")


@query(_AM + " SELECT s.event_id, round(value - coalesce((SELECT sum(after - before) FROM af WHERE af.user_id = s.user_id AND af.stop <= s.idx AND after IS NOT NULL), 0), 5) + 0.0 AS corrected FROM s")
def jump_correction(spark, d):
    s, found = _artifacts(spark, d)
    m = peaks.artifact_metrics(found, s, "user_id", "idx", "t", "value", 5).where("baseline_change is not null")
    out = peaks.jump_corrected(s, m, "user_id", "idx", "value")
    return s.select("event_id", "user_id", "idx").join(out.select("user_id", "idx", "corrected"), ["user_id", "idx"]).select("event_id", r("corrected", 5).alias("corrected"))


# -- comparison ---------------------------------------------------------------------

_W = L + ", g AS (SELECT time_idx, avg(v) FILTER (label = 0) AS ma, avg(v) FILTER (label = 1) AS mb, var_samp(v) FILTER (label = 0) AS va, var_samp(v) FILTER (label = 1) AS vb, count(v) FILTER (label = 0) AS na, count(v) FILTER (label = 1) AS nb FROM l GROUP BY time_idx), w AS (SELECT time_idx, (ma - mb) / sqrt(va / na + vb / nb) AS t, (va / na + vb / nb) ** 2 / ((va / na) ** 2 / (na - 1) + (vb / nb) ** 2 / (nb - 1)) AS df FROM g)"


def _welch(spark, d):
    return comparison.welch(trials.to_long(matrix(spark, d), ["vec_id", "label"]), "label", 0, 1)


@query(_W + " SELECT time_idx, round(t, 6) + 0.0 AS t, round(df, 4) + 0.0 AS df FROM w")
def welch_t_pointwise(spark, d):
    return _welch(spark, d).select("time_idx", r("t").alias("t"), r("df", 4).alias("df"))


@query(_W + ", f AS (SELECT time_idx, t, unnest([1, -1]) AS sign FROM w), k AS (SELECT *, time_idx - row_number() OVER (PARTITION BY sign ORDER BY time_idx) AS k FROM f WHERE sign * t > 1.0) SELECT sign, min(time_idx)::INTEGER AS start, max(time_idx)::INTEGER AS stop, round(abs(sum(t)), 5) + 0.0 AS mass FROM k GROUP BY sign, k")
def clusters_observed(spark, d):
    return comparison.clusters(_welch(spark, d), 1.0).select("sign", "start", "stop", r("mass", 5).alias("mass"))


@query("WITH p AS (SELECT o_orderkey, o_orderpriority, (o_orderkey * 7919 % 100003) / 100003.0 AS p FROM orders), q AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY p) AS k, count(*) OVER (PARTITION BY o_orderpriority) AS m FROM p) SELECT o_orderkey, round(least(1.0, min(p * m / k) OVER (PARTITION BY o_orderpriority ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) + 0.0 AS p_adj FROM q")
def bh_adjust(spark, d):
    p = read(spark, d, "orders").select("o_orderkey", "o_orderpriority", ((F.col("o_orderkey") * 7919 % 100003) / 100003.0).alias("p"))
    return relational.bh_adjust(p, ["o_orderpriority"], "p").select("o_orderkey", r("p_adj").alias("p_adj"))


@query("WITH g AS (SELECT l_returnflag, count(*) AS n, avg(l_quantity) AS m, var_pop(l_quantity) AS v FROM lineitem GROUP BY 1), s AS (SELECT sum(n) AS n, count(*) AS k, sum(n * m * m) - sum(n * m) ** 2 / sum(n) AS b, sum(n * v) AS w FROM g) SELECT 'l_returnflag' AS source, round(b, 2) + 0.0 AS ss_between, round(w, 1) + 0.0 AS ss_within, (k - 1)::BIGINT AS df1, (n - k)::BIGINT AS df2, round(b / (k - 1) / (w / (n - k)), 5) + 0.0 AS f, round(b / (b + w), 9) + 0.0 AS np2 FROM s")
def anova_oneway(spark, d):
    a = comparison.anova_oneway(read(spark, d, "lineitem"), "l_quantity", "l_returnflag")
    return a.select("source", r("ss_between", 2).alias("ss_between"), r("ss_within", 1).alias("ss_within"), "df1", "df2", r("f", 5).alias("f"), r("np2", 9).alias("np2"))


@query("WITH c AS (SELECT l_suppkey, l_returnflag, avg(l_quantity) AS y FROM lineitem GROUP BY 1, 2), k AS (SELECT count(DISTINCT l_returnflag) AS k FROM c), o AS (SELECT l_suppkey FROM c GROUP BY 1 HAVING count(*) = (SELECT k FROM k)), e AS (SELECT c.* FROM c JOIN o USING (l_suppkey)), s AS (SELECT count(*) AS n, var_pop(m) AS v FROM (SELECT avg(y) AS m FROM e GROUP BY l_suppkey)), l AS (SELECT var_pop(m) AS v FROM (SELECT avg(y) AS m FROM e GROUP BY l_returnflag)), t AS (SELECT var_pop(y) AS v FROM e), a AS (SELECT n * k * l.v AS se, n * k * s.v AS ss, n * k * (t.v - l.v - s.v) AS er, (k - 1)::BIGINT AS df1, ((n - 1) * (k - 1))::BIGINT AS df2 FROM s, l, t, k) SELECT round(se, 4) + 0.0 AS ss_effect, round(ss, 4) + 0.0 AS ss_subject, round(er, 4) + 0.0 AS ss_error, df1, df2, round(se / df1 / (er / df2), 5) + 0.0 AS f, round(se / (se + er + ss), 6) + 0.0 AS ng2 FROM a")
def anova_rm(spark, d):
    a = comparison.anova_rm(read(spark, d, "lineitem"), "l_quantity", "l_returnflag", "l_suppkey")
    return a.select(r("ss_effect", 4).alias("ss_effect"), r("ss_subject", 4).alias("ss_subject"), r("ss_error", 4).alias("ss_error"), "df1", "df2", r("f", 5).alias("f"), r("ng2").alias("ng2"))


# -- simulation ---------------------------------------------------------------------


@query("SELECT i::BIGINT AS idx, i / 20.0 AS t, round(50 * exp(-(i / 20.0) / 300) + 20 * exp(-(i / 20.0) / 10000) + 10, 6) + 0.0 AS base FROM range(600) r(i)")
def sim_bleaching(spark, d):
    return sim.time_base(spark, 30, 20).withColumn("base", r(sim.bleaching(F.col("t"))))


@query("WITH o AS (SELECT unnest([2.0, 3.5, 10.02]) AS o), g AS (SELECT j, 0.02 * ((j / 20.0) / 2) ** 2 * exp(2 - j / 20.0) AS v FROM range(20000) r(j)), c AS (SELECT * FROM g WHERE j <= (SELECT max(j) FROM g WHERE v > 1e-4 * (SELECT max(v) FROM g))), k AS (SELECT (ceil(o * 20) + j)::BIGINT AS idx, v FROM o, c), e AS (SELECT idx, sum(v) AS v FROM k GROUP BY idx) SELECT i::BIGINT AS idx, round(coalesce(v, 0), 8) + 0.0 AS event FROM range(600) r(i) LEFT JOIN e ON i = idx")
def sim_event_kernel(spark, d):
    out = sim.event_layer(sim.time_base(spark, 30, 20), [2.0, 3.5, 10.02], 20, None, sim.gamma_kernel)
    return out.select("idx", r("event", 8).alias("event"))


# -- sequential numerics: grouped maps, checked against numpy in the tests ------------


@query()
def lowpass(spark, d):
    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("idx")
        return pd.DataFrame({"user_id": p["user_id"], "idx": p["idx"], "filtered": kernels.lowpass(p["value"].to_numpy(), 10.0, 1.0, 4)})

    return samples(spark, d).select("user_id", "idx", "value").groupBy("user_id").applyInPandas(run, "user_id long, idx long, filtered double")


@query()
def irls_fit(spark, d):
    def run(p: pd.DataFrame) -> pd.DataFrame:
        y, x = p["l_extendedprice"].to_numpy(), p["l_quantity"].to_numpy()
        fit, beta = kernels.irls(y, x)
        r2 = 1 - ((y - fit) ** 2).sum() / ((y - y.mean()) ** 2).sum()
        return pd.DataFrame({"l_suppkey": [p["l_suppkey"].iloc[0]], "intercept": [beta[0]], "slope": [beta[1]], "r2": [r2]})

    return read(spark, d, "lineitem").select("l_suppkey", "l_extendedprice", "l_quantity").groupBy("l_suppkey").applyInPandas(run, "l_suppkey long, intercept double, slope double, r2 double")


@query()
def artifact_repair(spark, d):
    s, found = _artifacts(spark, d)

    def run(key, p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("idx")
        y, t = p["value"].to_numpy(), np.arange(len(p), dtype=float)
        for a, b in q[["start", "stop"]].itertuples(index=False):
            y = kernels.fill(y, t, int(a), int(b), 4, 4)
        return pd.DataFrame({"event_id": p["event_id"], "repaired": y})

    return s.select("event_id", "user_id", "idx", "value").groupBy("user_id").cogroup(found.select(F.col("user_id").alias("of"), "start", "stop").groupBy("of")).applyInPandas(run, "event_id long, repaired double")


@query()
def permutation_test(spark, d):
    """One row per observed cluster with its share of permutations of at least that mass."""
    a, b = comparison.matrices(matrix(spark, d), "label", 0, 1)
    null = comparison.permutation_masses(a, b, comparison.permutations(spark))
    seen = comparison.clusters(_welch(spark, d), comparison.critical(a, b))
    return comparison.cluster_p(seen, null, comparison.PERMUTATIONS)


# two-sided p by Simpson's rule over the density of t from 0 to |t|
_PW = _W + ", q AS (SELECT time_idx, t, df, 1 - 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * abs(t) / 600 / 3 * list_sum(list_transform(range(0, 601), lambda k: CASE WHEN k IN (0, 600) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * pow(1 + (t * k / 600) ** 2 / df, -(df + 1) / 2))) AS p FROM w), o AS (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM q)"


@query(_PW + " SELECT time_idx, round(t, 6) + 0.0 AS t, round(df, 4) + 0.0 AS df, round(p, 6) + 0.0 AS p, round(least(1.0, min(p * m / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) + 0.0 AS p_adj FROM o")
def pointwise_p(spark, d):
    own = comparison.with_p(_welch(spark, d)).withColumn("g", F.lit(0))
    return relational.bh_adjust(own, ["g"], "p").select("time_idx", r("t").alias("t"), r("df", 4).alias("df"), r("p").alias("p"), r("p_adj").alias("p_adj"))
