"""Third part of the catalogue: full extraction, labelled artifacts, trial sets, point-wise models, simulated libraries and pipelines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from .. import simulation
from ..operators import artifacts, comparison, extraction, peaks, pointwise, recording, relational, trials, trialset
from ..plans import pipeline as pipelines
from .queries import _A, _AM, _G, L, S, X, matrix, query, r, read, samples

HOUR, HALF = 3600.0, 43200.0

# -- extraction ---------------------------------------------------------------------

_E = S + ", e AS (SELECT user_id, min(t) AS a, max(t) AS b FROM s GROUP BY user_id), p AS (SELECT user_id, t AS c, (row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1)::BIGINT AS trial_ord FROM s WHERE event_type = 'purchase'), ok AS (SELECT user_id, c, trial_ord, row_number() OVER (PARTITION BY user_id ORDER BY trial_ord) AS trial_num FROM p JOIN e USING (user_id) WHERE c - 86400 >= a AND c + 43200 <= b)"
_READ = ", g{n} AS (SELECT user_id, trial_num, k, c + {low} + k * 3600 AS q FROM ok, range({size}) r(k)), b{n} AS (SELECT g{n}.*, s.t AS pt, s.value AS pv FROM g{n} ASOF JOIN s ON g{n}.user_id = s.user_id AND g{n}.q >= s.t), v{n} AS (SELECT b{n}.*, CASE WHEN s.t > pt THEN pv + (s.value - pv) * (q - pt) / (s.t - pt) ELSE pv END AS v FROM b{n} ASOF JOIN s ON b{n}.user_id = s.user_id AND b{n}.q <= s.t)"


def _extracted(spark, d, how: str, **more):
    s = samples(spark, d)
    return extraction.extract(s, s, "purchase", (-HALF, HALF), 1 / HOUR, baseline_bounds=(-2 * HALF, -HALF), normalisation=how, alignment="interp", **more)


def _points(frame):
    return frame.select("user_id", "trial_num", F.posexplode("x").alias("time_idx", "signal"))


@query(_E + _READ.format(n=1, low=-43200, size=24) + _READ.format(n=2, low=-86400, size=12) + ", m AS (SELECT user_id, trial_num, avg(v) AS m FROM v2 GROUP BY user_id, trial_num) SELECT v1.user_id, trial_num::INTEGER AS trial_num, k::INTEGER AS time_idx, round(v - m, 4) + 0.0 AS signal FROM v1 JOIN m USING (user_id, trial_num)")
def extract_interp_zero(spark, d):
    return _points(_extracted(spark, d, "zero").trials).select("user_id", "trial_num", "time_idx", r("signal", 4).alias("signal"))


@query(_E + _READ.format(n=1, low=-43200, size=24) + _READ.format(n=2, low=-86400, size=12) + ", m AS (SELECT user_id, trial_num, median(v) AS m FROM v2 GROUP BY user_id, trial_num), w AS (SELECT v2.user_id, v2.trial_num, 1.4826 * median(abs(v - m)) AS w FROM v2 JOIN m ON v2.user_id = m.user_id AND v2.trial_num = m.trial_num GROUP BY v2.user_id, v2.trial_num) SELECT v1.user_id, v1.trial_num::INTEGER AS trial_num, k::INTEGER AS time_idx, CASE WHEN w > 0 THEN round((v - m) / w, 3) + 0.0 END AS signal FROM v1 JOIN m ON v1.user_id = m.user_id AND v1.trial_num = m.trial_num JOIN w ON v1.user_id = w.user_id AND v1.trial_num = w.trial_num")
def extract_interp_mad(spark, d):
    return _points(_extracted(spark, d, "mad").trials).select("user_id", "trial_num", "time_idx", r("signal", 3).alias("signal"))


@query(_E + _READ.format(n=2, low=-86400, size=12) + " SELECT user_id, trial_num::INTEGER AS trial_num, k::INTEGER AS time_idx, round(v, 4) + 0.0 AS signal FROM v2")
def extract_baselines(spark, d):
    return _points(_extracted(spark, d, "none").baselines).select("user_id", "trial_num", "time_idx", r("signal", 4).alias("signal"))


@query(_E + ", h AS (SELECT ok.user_id, trial_num, event_type AS label, s.t - c AS rel, row_number() OVER (PARTITION BY ok.user_id, trial_num, event_type ORDER BY s.t, event_id) AS k FROM ok JOIN s ON ok.user_id = s.user_id AND s.t BETWEEN c - 43200 AND c + 43200) SELECT user_id, trial_num::INTEGER AS trial_num, label || CASE WHEN k > 1 THEN '_occurrence_#' || k ELSE '' END AS label, round(rel, 3) + 0.0 AS rel FROM h")
def extract_all_events(spark, d):
    got = _extracted(spark, d, "none", all_events=True, conflict="all").trials
    return got.select("user_id", "trial_num", F.explode("events").alias("label", "rel")).select("user_id", "trial_num", "label", r("rel", 3).alias("rel"))


@query(_E + " SELECT user_id, trial_num::INTEGER AS trial_num, 'purchase' AS align_event, round(c, 3) + 0.0 AS align_t, round(c - 43200, 3) + 0.0 AS start_time, round(c - 43200 + 23 * 3600, 3) + 0.0 AS stop_time FROM ok")
def extract_observations(spark, d):
    got = _extracted(spark, d, "none").trials
    return got.select("user_id", "trial_num", "align_event", r("align_t", 3).alias("align_t"), r("start_time", 3).alias("start_time"), r("stop_time", 3).alias("stop_time"))


@query(S + ", e AS (SELECT user_id, min(t) AS a, max(t) AS b FROM s GROUP BY user_id), c AS (SELECT user_id, k, x FROM e, (VALUES (0, 864000.0), (1, 432000.0)) v(k, x)), n AS (SELECT c.user_id, k, x, s.t, row_number() OVER (PARTITION BY c.user_id, k ORDER BY abs(s.t - x), s.t) AS o FROM c JOIN s ON s.user_id = c.user_id) SELECT n.user_id, k::BIGINT AS trial_ord, n.x::DOUBLE AS align_t, round(t, 3) + 0.0 AS at, (t - 86400 >= a AND t + 43200 <= b) AS ok FROM n JOIN e ON n.user_id = e.user_id WHERE o = 1")
def windows_at_times(spark, d):
    s = samples(spark, d)
    at, _ = extraction.resolve(s, s, [864000.0, 432000.0], "user_id", "event_type", "t", "event_id")
    got = extraction.windows(at, s, "align_t", (-2 * HALF, HALF + HOUR), 1 / HOUR, "nearest", "user_id", "t", "idx", "value", ["user_id", "trial_ord"])
    return got.join(at.select("user_id", "trial_ord", "align_t"), ["user_id", "trial_ord"]).select("user_id", "trial_ord", "align_t", r("at", 3).alias("at"), "ok")


@query(S + ", k AS (SELECT user_id, min(t) AS a, max(t) AS b FROM s WHERE idx >= 5 AND idx < 15 GROUP BY user_id) SELECT event_id FROM s JOIN k USING (user_id) WHERE t BETWEEN a AND b")
def trim_events(spark, d):
    s = samples(spark, d)
    return recording.trim_events(s.select("event_id", "user_id", "t"), recording.trim_index(s, 5, 15), "user_id").select("event_id")


# -- artifacts -----------------------------------------------------------------------

_T = _AM + ", sz AS (SELECT user_id, ceil(count(*) / 10.0)::BIGINT AS size FROM s GROUP BY user_id), ck AS (SELECT d.user_id, least(idx // size, 9) AS chunk, d FROM d JOIN sz USING (user_id)), cm AS (SELECT user_id, chunk, median(d) AS med FROM ck GROUP BY user_id, chunk), ca AS (SELECT ck.user_id, ck.chunk, any_value(med) AS med, median(abs(d - med)) AS mad FROM ck JOIN cm ON ck.user_id = cm.user_id AND ck.chunk = cm.chunk GROUP BY ck.user_id, ck.chunk), pl AS (SELECT af.*, least(((start + stop) // 2) // size, 9) AS chunk FROM af JOIN sz ON af.user_id = sz.user_id), pm AS (SELECT pl.*, ca.med, ca.mad AS cmad FROM pl LEFT JOIN ca ON pl.user_id = ca.user_id AND pl.chunk = ca.chunk), p2 AS (SELECT user_id, median(cmad) AS m2 FROM pm GROUP BY user_id), sp AS (SELECT pm.user_id, median(abs(cmad - m2)) AS spread FROM pm JOIN p2 ON pm.user_id = p2.user_id GROUP BY pm.user_id), fr AS (SELECT pm.*, spread, 0.6745 * ((after - before) / (stop - start) - med) AS far FROM pm JOIN sp ON pm.user_id = sp.user_id) SELECT user_id, start, stop, CASE WHEN spread > 0 THEN round(far / spread, 3) + 0.0 END AS jump_score, CASE WHEN far IS NULL OR (spread = 0 AND far = 0) THEN NULL WHEN spread = 0 OR abs(far / spread) >= 10 THEN 'jump' ELSE 'spike' END AS type FROM fr"


def _labelled(spark, d, reference: str | None = None):
    s = samples(spark, d).withColumn("reference", F.col("value") * 0.8 + F.col("event_id") % 7)
    return s, artifacts.detect(s, "user_id", "idx", "t", "value", reference, 2.0, expand=(1, 1), buffer=5, chunks=10)


@query(_T)
def artifact_types(spark, d):
    found = _labelled(spark, d)[1]
    return found.select("user_id", "start", "stop", F.when(F.abs("jump_score") != float("inf"), r("jump_score", 3)).alias("jump_score"), "type")


@query(_A + ", f AS (SELECT DISTINCT s.event_id FROM s JOIN iv ON s.user_id = iv.user_id AND s.idx >= start AND s.idx < stop) SELECT s.event_id, f.event_id IS NOT NULL AS artifact FROM s LEFT JOIN f ON s.event_id = f.event_id")
def artifact_mask(spark, d):
    s, found = _labelled(spark, d)
    return artifacts.flagged(s, found, "user_id", "idx").select("event_id", "artifact")


_PAIRS = ", wp AS (SELECT iv.user_id, start, stop, value AS x, value * 0.8 + event_id % 7 AS y FROM iv JOIN s ON s.user_id = iv.user_id AND idx >= start AND idx < stop), rk AS (SELECT *, rank() OVER (PARTITION BY user_id, start ORDER BY x) + (count(*) OVER (PARTITION BY user_id, start, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY user_id, start ORDER BY y) + (count(*) OVER (PARTITION BY user_id, start, y) - 1) / 2 AS ry FROM wp), rc AS (SELECT user_id, start, stop, CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx, ry) END AS rho FROM rk GROUP BY user_id, start, stop)"


@query(_A + _PAIRS + " SELECT user_id, start, stop, round(rho, 6) + 0.0 AS reference_cor FROM rc WHERE rho >= 0.5")
def artifact_reference_filter(spark, d):
    return _labelled(spark, d, "reference")[1].select("user_id", "start", "stop", r("reference_cor").alias("reference_cor"))


@query()
def artifact_correction(spark, d):
    s, found = _labelled(spark, d)
    return artifacts.correct(s, found, "user_id", "idx", "t", "value", buffer=5)


# -- trial sets ------------------------------------------------------------------------


def _set(spark, d):
    frame = matrix(spark, d).withColumn("doubled", F.transform("x", lambda v: v * 2))
    return trialset.TrialSet(frame, tuple(k / 8 for k in range(64)), ("doubled",), {"source": "embeddings"})


_C = L + ", c AS (SELECT label, time_idx, avg(v) AS m, stddev_pop(v) AS sd, max(v) AS hi FROM l GROUP BY label, time_idx), o AS (SELECT label, count(*) AS n, avg(vec_id) AS vm, stddev_pop(vec_id) AS vs, max(vec_id)::DOUBLE AS vx FROM x GROUP BY label)"


def _collapsed(spark, d):
    return _set(spark, d).collapse("label", "mean", {"std": "std", "max": F.max}, data_cols=["vec_id"])


@query(_C + " SELECT label, time_idx, round(time_idx / 8.0, 6) + 0.0 AS time, round(m, 6) + 0.0 AS signal, round(sd, 6) + 0.0 AS error FROM c")
def collapse_layers_long(spark, d):
    return _collapsed(spark, d).to_long(["label"], err_layer="std").select("label", "time_idx", r("time").alias("time"), r("signal").alias("signal"), r("error").alias("error"))


@query(_C + " SELECT label, n, round(vm, 4) + 0.0 AS vec_id, round(vs, 4) + 0.0 AS vec_id_std, round(vx, 4) + 0.0 AS vec_id_max FROM o")
def collapse_observations(spark, d):
    return _collapsed(spark, d).obs.select("label", "n", r("vec_id", 4).alias("vec_id"), r("vec_id_std", 4).alias("vec_id_std"), r(F.col("vec_id_max").cast("double"), 4).alias("vec_id_max"))


@query(L + " SELECT time_idx, round(avg(v), 6) + 0.0 AS mean, round(median(v), 6) + 0.0 AS median FROM l GROUP BY time_idx")
def collapse_everything(spark, d):
    return _set(spark, d).collapse(None, "mean", {"median": "median"}).to_long([], err_layer="median").select("time_idx", r("signal").alias("mean"), r("error").alias("median"))


@query(L + " SELECT vec_id, (time_idx // 4)::INTEGER AS time_idx, round(avg(v), 6) + 0.0 AS signal, round(avg(v * 2), 6) + 0.0 AS error, round(avg(time_idx / 8.0), 6) + 0.0 AS time FROM l GROUP BY vec_id, time_idx // 4")
def downsample_layers(spark, d):
    return _set(spark, d).downsample(4).to_long(["vec_id"], err_layer="doubled").select("vec_id", "time_idx", r("signal").alias("signal"), r("error").alias("error"), r("time").alias("time"))


@query(L + " SELECT vec_id, (time_idx - 16)::INTEGER AS time_idx, round(v, 6) + 0.0 AS signal, round(v * 2, 6) + 0.0 AS error FROM l WHERE time_idx >= 16 AND time_idx < 32")
def window_layers(spark, d):
    return _set(spark, d).window(F.lit(3.0), (-1.0, 1.0)).to_long(["vec_id"], err_layer="doubled").select("vec_id", "time_idx", r("signal").alias("signal"), r("error").alias("error"))


@query("SELECT vec_id, label::VARCHAR || '_' || (vec_id % 3)::VARCHAR AS \"group\", 'label: ' || label::VARCHAR || ', third: ' || (vec_id % 3)::VARCHAR AS text FROM embeddings")
def trial_labels(spark, d):
    own = _set(spark, d).add_obs({"third": F.col("vec_id") % 3})
    own = own.group_labels(["label", "third"]).with_frame(own.group_labels(["label", "third"]).frame.withColumn("value", F.col("label")))
    named = trials.labels(own.frame, ["label", "third"]).withColumnRenamed("label", "text")
    return named.select("vec_id", "group", "text")


@query("SELECT vec_id, count(*) AS n FROM (SELECT vec_id FROM embeddings UNION ALL SELECT vec_id FROM embeddings WHERE label = 1) GROUP BY vec_id")
def combine_sets(spark, d):
    own = _set(spark, d)
    return own.combine([own.with_frame(own.frame.where("label = 1"))]).frame.groupBy("vec_id").agg(F.count("*").alias("n"))


@query(L + " SELECT label, time_idx, round(avg(v), 6) + 0.0 AS mean, round(stddev_pop(v), 6) + 0.0 AS std, count(v) AS n FROM l GROUP BY label, time_idx")
def group_means(spark, d):
    return comparison.group_means(trials.to_long(matrix(spark, d), ["label"]), "label").select("label", "time_idx", r("mean").alias("mean"), r("std").alias("std"), "n")


# -- peaks, models, designs -------------------------------------------------------------


@query(_G + ", k AS (SELECT vec_id, count(*) AS n_peaks FROM z GROUP BY vec_id) SELECT x.vec_id, coalesce(n_peaks, 0) AS n_peaks FROM x LEFT JOIN k ON x.vec_id = k.vec_id")
def peak_counts(spark, d):
    m = matrix(spark, d)
    found = peaks.merged_close(peaks.threshold_runs(m, "vec_id", threshold=1.5), "vec_id", 2)
    return peaks.peak_counts(m, found, "vec_id")


@query(L + ", c AS (SELECT time_idx, regr_slope(v, label) AS slope, regr_intercept(v, label) AS base, count(*) AS n, regr_sxx(v, label) AS sxx, regr_syy(v, label) AS syy, avg(label) AS mx FROM l GROUP BY time_idx), f AS (SELECT *, sqrt((syy - slope * slope * sxx) / (n - 2)) AS s FROM c) SELECT time_idx, unnest(['label', '(Intercept)']) AS term, round(unnest([slope, base]), 7) + 0.0 AS beta, round(unnest([s / sqrt(sxx), s * sqrt(1.0 / n + mx * mx / sxx)]), 7) + 0.0 AS se, n, round(s, 6) + 0.0 AS sigma FROM f")
def pointwise_model(spark, d):
    got = pointwise.fit(trials.to_long(matrix(spark, d), ["label"]), {"label": F.col("label")})
    return got.select("time_idx", "term", r("beta", 7).alias("beta"), r("se", 7).alias("se"), "n", r("sigma").alias("sigma"))


@query()
def pointwise_mixed_model(spark, d):
    long = trials.to_long(matrix(spark, d).withColumn("subject", F.col("vec_id") % 20), ["label", "subject"])
    return pointwise.fit(long, {"label": F.col("label")}, subject="subject")


@query()
def anova_two_way(spark, d):
    return comparison.anova(read(spark, d, "lineitem"), "l_quantity", ["l_returnflag", "l_linestatus"], 2)


@query()
def anova_p_values(spark, d):
    rows = read(spark, d, "lineitem").withColumn("g", F.col("l_suppkey") % 3)
    return comparison.anova_mixed(rows, "l_quantity", "g", "l_returnflag", "l_suppkey")


@query()
def pointwise_permutation(spark, d):
    a, b = comparison.matrices(matrix(spark, d), "label", 0, 1)
    got = comparison.pointwise_permutation(a, b, comparison.permutations(spark)).withColumn("g", F.lit(0))
    return relational.bh_adjust(got, ["g"], "p", "by").drop("g")


# -- simulation and pipelines -----------------------------------------------------------


def _library():
    return simulation.Library({"length_sec": 60.0, "frequency": 20.0, "n_events": 4, "movement": None, "gaussian": 0.05}, {"event_amplitude": [0.02, 0.1], "spikes": [0, 2]}, 2, 7)


@query()
def simulated_library(spark, d):
    return _library().generate(spark)


@query()
def simulated_trials(spark, d):
    """True trials of a library: its noiseless traces through the same extraction."""
    s, e = simulation.samples_and_events(_library().generate(spark))
    got = extraction.extract(s, e, "trial_cue", (-1.0, 3.0), 20.0, key="lib_id", label="label", value="neural_trace")
    return got.trials.select("lib_id", "trial_num", "align_t", "x")


def _halved(p: pd.DataFrame, factor: int = 2) -> pd.DataFrame:
    y = p.sort_values("idx")["value"].to_numpy()
    if len(y) < factor:
        raise ValueError("recording too short")
    return pd.DataFrame({"mean": y[: len(y) // factor * factor].reshape(-1, factor).mean(axis=1)})


def _numbered(p: pd.DataFrame, offset: float = 0.0) -> pd.DataFrame:
    return pd.DataFrame({"block": np.arange(len(p)), "mean": p["mean"] + offset})


@query(S + ", c AS (SELECT unnest(['plain', 'wide']) AS config, unnest([2, 5]) AS f, unnest([0.0, 1.0]) AS o) SELECT config, user_id, 'user_' || user_id AS experiment_id, idx // f AS block, round(avg(value) + any_value(o), 6) + 0.0 AS mean FROM s, c GROUP BY config, f, user_id, idx // f HAVING count(*) = f")
def staged_pipeline(spark, d):
    plan = pipelines.Pipeline({"shrink": _halved, "number": _numbered}, "block long, mean double", identify=lambda p: f"user_{p['user_id'].iloc[0]}")
    out = plan.run(samples(spark, d).select("user_id", "idx", "value"), "user_id", {"plain": {}, "wide": {"shrink": {"factor": 5}, "number": {"offset": 1.0}}})
    return out.where("error is null").select("config", "user_id", "experiment_id", "block", r("mean").alias("mean"))
