"""Second half of the catalogue: whole trials, rolling peaks, mixed designs, fits, batches, sources and streams."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from .. import sim
from ..kernels import fitting
from ..operators import comparison, experiment, peaks
from ..session import shared_path
from ..sources import recordings, sinks
from ..streaming import trials as streams
from . import batch
from .queries import S, X, matrix, query, r, read, samples

_PRE = S + ", n AS (SELECT user_id, max(idx) AS last FROM s GROUP BY user_id), p AS (SELECT user_id, t, idx AS c, (row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1)::BIGINT AS trial_ord FROM s WHERE event_type = 'purchase'), ok AS (SELECT p.* FROM p JOIN n USING (user_id) WHERE c - 4 >= 0 AND c + 5 <= last), b AS (SELECT ok.user_id, ok.trial_ord, avg(s.value) AS m, stddev_pop(s.value) AS sd FROM ok JOIN s ON s.user_id = ok.user_id AND s.idx BETWEEN c - 4 AND c - 1 GROUP BY ALL)"


@query(_PRE + " SELECT ok.user_id, ok.trial_ord, ok.t AS center_t, (s.idx - c + 2)::INTEGER AS time_idx, round((s.idx - c) / 2.0, 6) + 0.0 AS time, round((s.value - m) / CASE WHEN sd = 0 THEN 2.220446049250313e-16 ELSE sd END, 5) + 0.0 AS signal FROM ok JOIN b USING (user_id, trial_ord) JOIN s ON s.user_id = ok.user_id AND s.idx BETWEEN c - 2 AND c + 5")
def extract_trial_data(spark, d):
    s = samples(spark, d)
    out = experiment.trials_of(s, s, ["purchase"], (-1.0, 3.0), 2.0, baseline=(-2.0, 0.0), normalisation="zscore")
    return out.select("user_id", "trial_ord", "center_t", "time_idx", r("time").alias("time"), r("signal", 5).alias("signal"))


@query(X + ", i AS (SELECT vec_id, i, x[i + 1] AS v, list_transform(range(0, 9), lambda k: x[(CASE WHEN (i - 4 + k + 128) % 128 < 64 THEN (i - 4 + k + 128) % 128 ELSE 127 - (i - 4 + k + 128) % 128 END) + 1]) AS w FROM (SELECT *, unnest(range(0, 64)) AS i FROM x)), c AS (SELECT *, list_median(w) AS m FROM i), e AS (SELECT *, 1.4826 * list_median(list_transform(w, lambda z: abs(z - m))) AS s FROM c), f AS (SELECT vec_id, i, sign FROM (SELECT *, unnest([1, -1]) AS sign FROM e) WHERE sign * (v - m) > 2 * s), g AS (SELECT *, i - row_number() OVER (PARTITION BY vec_id, sign ORDER BY i) AS k FROM f) SELECT vec_id, CASE WHEN sign > 0 THEN 'positive' ELSE 'negative' END AS direction, min(i)::INTEGER AS start, max(i)::INTEGER AS stop FROM g GROUP BY vec_id, sign, k")
def threshold_peaks_rolling(spark, d):
    return peaks.rolling_runs(matrix(spark, d), "vec_id", 9, threshold=2.0)


_MIX = "WITH c0 AS (SELECT l_suppkey, l_suppkey % 3 AS g, l_returnflag AS l, avg(l_quantity) AS y FROM lineitem GROUP BY ALL), o AS (SELECT l_suppkey FROM c0 GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT l) FROM c0)), c AS (SELECT c0.* FROM c0 JOIN o USING (l_suppkey)), w AS (SELECT *, avg(y) OVER () AS m, avg(y) OVER (PARTITION BY g) AS mg, avg(y) OVER (PARTITION BY l) AS ml, avg(y) OVER (PARTITION BY g, l) AS mgl, avg(y) OVER (PARTITION BY l_suppkey) AS ms FROM c), s AS (SELECT sum((mg - m) ** 2) AS b, sum((ms - mg) ** 2) AS es, sum((ml - m) ** 2) AS wi, sum((mgl - mg - ml + m) ** 2) AS ia, sum((y - ms - mgl + mg) ** 2) AS ew, count(DISTINCT g) AS kg, count(DISTINCT l) AS kl, count(DISTINCT l_suppkey) AS n FROM w), u AS (SELECT 'between' AS source, b AS ss, kg - 1 AS df1, n - kg AS df2, es AS e FROM s UNION ALL SELECT 'within', wi, kl - 1, (n - kg) * (kl - 1), ew FROM s)"


#: The interaction as the remainder of the total sum of squares, as in an unbalanced design it has no orthogonal form.
_CROSSED = ", q AS (SELECT sum(y) ** 2 / count(*) AS q FROM c), gl AS (SELECT sum(s * s / n) AS q, count(*) AS m FROM (SELECT sum(y) AS s, count(*) AS n FROM c GROUP BY g, l)), gg AS (SELECT sum(s * s / n) AS q, count(*) AS m FROM (SELECT sum(y) AS s, count(*) AS n FROM c GROUP BY g)), ll AS (SELECT sum(s * s / n) AS q, count(*) AS m FROM (SELECT sum(y) AS s, count(*) AS n FROM c GROUP BY l)), ss AS (SELECT sum(s * s / n) AS q, count(*) AS m FROM (SELECT sum(y) AS s, count(*) AS n FROM c GROUP BY l_suppkey)), yy AS (SELECT sum(y * y) AS q FROM c), t AS (SELECT gl.q - gg.q - ll.q + q.q AS i, yy.q - ss.q - gl.q + gg.q AS e, (gg.m - 1) * (ll.m - 1) AS d1, (ss.m - gg.m) * (ll.m - 1) AS d2 FROM q, gl, gg, ll, ss, yy)"


#: F tail of an even number of numerator degrees of freedom, in closed form.
_TAIL = "pow({x}, df2 / 2) * list_sum(list_transform(range(0, df1 // 2), lambda k: exp(lgamma(df2 / 2 + k) - lgamma(df2 / 2) - lgamma(k + 1)) * pow(1 - {x}, k)))".format(x="(df2 / (df2 + df1 * (ss / df1) / (e / df2)))")


@query(_MIX + _CROSSED + ", a AS (SELECT * FROM u UNION ALL SELECT 'interaction', i, d1, d2, e FROM t) SELECT source, round(ss, 4) + 0.0 AS ss, df1::BIGINT AS df1, df2::BIGINT AS df2, round((ss / df1) / (e / df2), 4) + 0.0 AS f, round(ss / (ss + e), 6) + 0.0 AS np2, round(" + _TAIL + ", 6) + 0.0 AS p FROM a")
def anova_mixed(spark, d):
    rows = read(spark, d, "lineitem").withColumn("g", F.col("l_suppkey") % 3)
    a = comparison.anova_mixed(rows, "l_quantity", "g", "l_returnflag", "l_suppkey")
    return a.select("source", r("ss", 4).alias("ss"), "df1", "df2", r("f", 4).alias("f"), r("np2").alias("np2"), r("p").alias("p"))


@query(S + ", j AS (SELECT p.user_id, p.event_type, s.idx, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(s.t - p.t - 600), s.t) AS k FROM s p JOIN s ON s.user_id = p.user_id WHERE p.event_type IN ('click', 'purchase')), f AS (SELECT user_id, idx, bool_or(event_type = 'click') AS click, bool_or(event_type = 'purchase') AS purchase FROM j WHERE k = 1 GROUP BY ALL) SELECT s.event_id, coalesce(click, false) AS click, coalesce(purchase, false) AS purchase FROM s LEFT JOIN f ON s.user_id = f.user_id AND s.idx = f.idx")
def export_wide_flags(spark, d):
    s = samples(spark, d)
    return sinks.wide(s, s.withColumn("t", F.col("t") + 600), "user_id", "t", "event_type", ["click", "purchase"]).select("event_id", "click", "purchase")


@query("SELECT i::BIGINT AS idx, round(CASE WHEN i < 10 THEN (i/10.0)**3*((i/10.0)*((i/10.0)*6-15)+10) WHEN i < 30 THEN 1.0 WHEN i < 50 THEN ((50-i)/20.0)**3*(((50-i)/20.0)*(((50-i)/20.0)*6-15)+10) ELSE 0.0 END, 6) + 0.0 AS trapezoid, round(0.5 * (1 - cos(pi() * least(i / 20.0, 1))), 6) + 0.0 AS taper FROM range(80) r(i)")
def sim_tapers(spark, d):
    b = sim.time_base(spark, 8, 10)
    return b.select("idx", r(sim.smooth_trapezoid_kernel(F.col("t"), 1.0, 1.0, 2.0, 2.0)).alias("trapezoid"), r(sim.half_hann(F.col("idx") / 20)).alias("taper"))


# -- streams: the rows that the watermark has released once the source is drained -----


def _stream(spark, d):
    schema = read(spark, d, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return events.withColumn("ts", F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")))


@query("SELECT a.event_id AS align_id, s.event_id AS sample_id, s.value FROM events a JOIN events s ON s.user_id = a.user_id AND s.ts BETWEEN a.ts - INTERVAL 6 HOUR AND a.ts + INTERVAL 12 HOUR WHERE a.event_type = 'purchase'")
def stream_trials(spark, d):
    out = streams.around(_stream(spark, d), "purchase", "6 hours", "12 hours")
    return streams.drained(out.select("align_id", "sample_id", "value"), shared_path(spark, "stream_trials"))


@query("WITH e AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM e) SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 12 HOUR) AS stop_us, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM g GROUP BY user_id, g HAVING max(ts) + INTERVAL 12 HOUR <= (SELECT max(date_trunc('millisecond', ts)) FROM events) - INTERVAL 1 HOUR")
def stream_sessions(spark, d):
    out = streams.drained(streams.sessions(_stream(spark, d), "12 hours"), shared_path(spark, "stream_sessions"))
    return out.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("stop").alias("stop_us"), "n", r("total", 4).alias("total"))


@query("WITH b AS (SELECT *, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS w FROM events) SELECT event_type, epoch_us(w) AS start_us, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM b GROUP BY event_type, w HAVING w + INTERVAL 6 HOUR <= (SELECT max(date_trunc('millisecond', ts)) FROM events) - INTERVAL 1 HOUR")
def stream_tumbling(spark, d):
    out = streams.drained(streams.tumbling(_stream(spark, d), "6 hours"), shared_path(spark, "stream_tumbling"))
    return out.select("event_type", F.unix_micros("start").alias("start_us"), "n", r("total", 4).alias("total"))


# -- sequential numerics, checked in the tests ----------------------------------------


@query()
def preprocess(spark, d):
    s = samples(spark, d).withColumn("reference", F.col("value") * 0.8 + (F.col("event_id") % 7))
    return experiment.preprocess(s, "user_id", "t", "value", "reference", cutoff=None, fit="IRLS", correction="dF", normalisation="zscore")


@query()
def downsample_resample(spark, d):
    def run(parts):
        for p in parts:
            yield pd.DataFrame({"vec_id": p["vec_id"], "x": [fitting.resample(np.asarray(x), 4).tolist() for x in p["x"]]})

    return matrix(spark, d).select("vec_id", "x").mapInPandas(run, "vec_id long, x array<double>")


@query()
def bleaching_fit(spark, d):
    recordings.register(spark)
    s = spark.read.format("simulated_recordings").option("recordings", 8).option("seconds", 120).load()

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("idx")
        _, b, r2 = fitting.bleaching_fit(p["raw_isosbestic"].to_numpy(), p["t"].to_numpy(), 100)
        return pd.DataFrame([[p["recording_id"].iloc[0], *b, r2]], columns=["recording_id", "a1", "b1", "a2", "b2", "c", "r2"])

    return s.groupBy("recording_id").applyInPandas(run, "recording_id long, a1 double, b1 double, a2 double, b2 double, c double, r2 double")


@query()
def cluster_depth(spark, d):
    a, b = comparison.matrices(matrix(spark, d), "label", 0, 1)
    return comparison.cluster_depth(a, b, comparison.permutations(spark))


def _job(p: pd.DataFrame, factor: int, cutoff: float | None = None) -> pd.DataFrame:
    y = p.sort_values("idx")["value"].to_numpy()
    if len(y) < factor:
        raise ValueError("recording too short")
    y = y[: len(y) // factor * factor].reshape(-1, factor).mean(axis=1)
    return pd.DataFrame({"block": np.arange(len(y)), "mean": y})


@query(S + ", c AS (SELECT unnest(['factor-2_perm0', 'factor-5_perm1']) AS config, unnest([2, 5]) AS f) SELECT config, user_id, idx // f AS block, round(avg(value), 6) + 0.0 AS mean FROM s, c GROUP BY config, f, user_id, idx // f HAVING count(*) = f")
def batch_pipeline(spark, d):
    out = batch.run(samples(spark, d).select("user_id", "idx", "value"), "user_id", _job, batch.permutations_of({"factor": [2, 5]}), "block long, mean double")
    return batch.finished(out).select("config", "user_id", "block", r("mean").alias("mean"))
