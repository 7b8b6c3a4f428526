import json

import numpy as np
import pandas as pd
import pytest

from trialforge.kernels import fitting
from trialforge.operators import comparison, experiment, peaks
from trialforge.plans import batch
from trialforge.sources import recordings, sinks


def test_resample_equals_the_direct_sum():
    x = np.random.default_rng(3).standard_normal(50).cumsum()
    for up, down in ((1, 4), (2, 3), (3, 1)):
        rate = max(up, down)
        k = np.arange(-10 * rate, 10 * rate + 1)
        taps = np.sinc(k / rate) * np.kaiser(len(k), 5)
        taps *= up / taps.sum()
        line = x[0] + (x[-1] - x[0]) / 49 * np.arange(50)
        m = -(-50 * up // down)
        want = []
        for o in range(m):
            lag = o * down - np.arange(50) * up
            near = np.abs(lag) <= 10 * rate
            want.append(((x - line)[near] * taps[lag[near] + 10 * rate]).sum() + x[0] + (x[-1] - x[0]) / 49 * o * down / up)
        assert np.allclose(fitting.resample(x, down, up), want)


def test_resample_keeps_a_line_and_times():
    assert np.allclose(fitting.resample(np.arange(41.0), 4), np.arange(0, 41, 4))
    assert np.allclose(fitting.resample_time(np.arange(8) / 10, 4), [0, 0.4])
    with pytest.raises(ValueError):
        fitting.resample_time(np.array([0, 1, 3.0]), 2)


def test_lowess_follows_a_noisy_line_despite_an_outlier():
    x = np.arange(100.0)
    y = 2 * x + 1 + 0.1 * np.random.default_rng(0).standard_normal(100)
    y[50] = 500
    assert np.abs(fitting.lowess(y, x, 0.2) - (2 * x + 1)).max() < 0.3


def test_bleaching_fit_recovers_the_decay():
    t = np.arange(0, 120, 0.05)
    true = 2 * np.exp(-0.08 * t) + np.exp(-0.01 * t) + 5
    fit, _, r2 = fitting.bleaching_fit(true + 1e-3 * np.sin(0.7 * t), t, 40)
    assert r2 > 0.99 and np.median(np.abs(fit - true)) < 0.05


def test_rolling_peaks_equal_numpy(spark):
    x = np.random.default_rng(5).standard_normal((4, 30))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k int, x array<double>")
    for width in (5, 6):
        want = set()
        for i, v in enumerate(x):
            w = fitting.mirrored_windows(v, width)
            for sign, name in ((1, "positive"), (-1, "negative")):
                want |= {(i, name, s, e - 1) for s, e in comparison.mask_runs(sign * (v - w.mean(axis=1)) > w.std(axis=1))}
        got = peaks.rolling_runs(frame, "k", width, threshold=1.0, center="mean", scale="std")
        assert {tuple(r) for r in got.collect()} == want


def test_mixed_anova_on_a_balanced_table(spark):
    y = np.random.default_rng(1).standard_normal((2, 4, 3))  # group, subject, level
    rows = [(g, g * 4 + s, k, float(y[g, s, k])) for g in range(2) for s in range(4) for k in range(3)]
    got = {r.source: r for r in comparison.anova_mixed(spark.createDataFrame(rows, "g int, s int, l int, y double"), "y", "g", "l", "s").collect()}
    m, mg, ml, mgl, ms = y.mean(), y.mean((1, 2)), y.mean((0, 1)), y.mean(1), y.mean(2)
    inter = 4 * ((mgl - mg[:, None] - ml + m) ** 2).sum()
    err = ((y - ms[:, :, None] - mgl[:, None, :] + mg[:, None, None]) ** 2).sum()
    assert np.isclose(got["between"].ss, 12 * ((mg - m) ** 2).sum()) and np.isclose(got["within"].ss, 8 * ((ml - m) ** 2).sum())
    assert np.isclose(got["interaction"].ss, inter) and np.isclose(got["interaction"].f, inter / 2 / (err / 12))


def test_cluster_depth_finds_a_planted_cluster(spark):
    rng = np.random.default_rng(2)
    a, b = rng.standard_normal((15, 20)), rng.standard_normal((15, 20))
    a[:, 6:11] += 4
    got = comparison.cluster_depth(a, b, spark.range(200).withColumnRenamed("id", "perm"), 2.0).toPandas()
    assert (got[got.time_idx.between(6, 10)].p < 0.05).all()
    assert comparison.step_down(np.array([3.0, 1.0]), np.array([[4.0, 0.0], [0.0, 2.0]])).tolist() == [0.5, 0.5]


def test_csv_recording(spark, tmp_path):
    rows = ["time,experimental,isosbestic,event1,event2,event3", "0,10.4,3.1,0,,False", "1,3.2,2.8,0,1,False", "2,2.4,2.6,0,,", "3,5.7,2.5,0,,True", "4,6.5,2.4,1,,False", "5,5.3,2.3,0,,False"]
    (tmp_path / "a.csv").write_text("\n".join(rows) + "\n", encoding="utf-8-sig")
    at = str(tmp_path / "a.csv")
    rec, s, ev = recordings.read_csv(spark, at, "time", "experimental", "isosbestic", ["event1", "event2", "event3"])
    assert rec.first().frequency == 1.0 and s.count() == 6 and s.where("raw_isosbestic is null").count() == 0
    assert {(r.label, r.t) for r in ev.collect()} == {("event1", 4.0), ("event2", 1.0), ("event3", 3.0)}
    assert recordings.read_csv(spark, at, "time", "experimental", "none")[1].where("raw_isosbestic is not null").count() == 0
    with pytest.raises(ValueError):
        recordings.read_csv(spark, at, "time", "nothing")
    with pytest.raises(KeyError):
        recordings.read_csv(spark, at, "time", "experimental", None, ["nothing"])
    assert recordings.discover(str(tmp_path), pattern="*.csv") == [at]


def test_annotations_and_text(spark, tmp_path):
    at = str(tmp_path / "a.json")
    with open(at, "w") as f:
        json.dump({"key1": "value1", "box": {"key2": 50}}, f)
    assert recordings.read_annotation(None) == {} and recordings.read_annotation(at, parent_key="box") == {"key2": 50}
    for bad in ({"path": str(tmp_path / "no")}, {"path": at, "handler": "xml"}, {"path": at, "parent_key": "key1"}, {"path": at, "parent_key": "no"}):
        with pytest.raises(ValueError):
            recordings.read_annotation(**bad)
    assert recordings.read_annotations(spark, at).first().key1 == "value1"
    nested = {"a": "1", "b": {"c": "2", "d": {"e": "3"}}, "f": "4"}
    sinks.write_text_dict(nested, str(tmp_path / "t.txt"))
    assert recordings.read_text_dict(str(tmp_path / "t.txt")) == nested


def test_trials_and_csv_round_trips(spark, tmp_path):
    frame, at = spark.createDataFrame([(1, [1.0, 2.0])], "k int, x array<double>"), str(tmp_path / "m")
    sinks.write_trials(frame, at, [0.0, 0.5], {"frequency": 2})
    sinks.append_trials(frame.selectExpr("k + 1 AS k", "x"), at, [0.0, 0.5])
    got, axis, meta = sinks.read_trials(spark, at)
    assert sorted(r.k for r in got.collect()) == [1, 2] and axis == [0.0, 0.5] and meta == {"frequency": 2}
    with pytest.raises(ValueError):
        sinks.append_trials(frame, at, [0.0, 0.6])
    table = spark.createDataFrame([(1, 2.0)], "a int, b double")
    sinks.write_csv(table, str(tmp_path / "c"))
    sinks.append_csv(table, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 2
    with pytest.raises(ValueError):
        sinks.append_csv(table.select("b", "a"), str(tmp_path / "c"))
    assert sinks.long(table, ["a"], ["b", "missing"]).collect()[0].asDict() == {"a": 1, "source": "b", "value": 2.0}


def test_batches_isolate_failures(spark):
    def halve(p: pd.DataFrame, by: float, more: int = 0) -> pd.DataFrame:
        if p["v"].iloc[0] < 0:
            raise RuntimeError("negative")
        return pd.DataFrame({"half": p["v"] / by + more})

    frame = spark.createDataFrame([(1, 4.0), (2, -1.0)], "k int, v double")
    out = batch.run(frame, "k", halve, batch.permutations_of({"by": [2.0, 4.0]}), "half double").collect()
    assert {(r.config, r.k, r.half) for r in out if r.error is None} == {("by-2.0_perm0", 1, 2.0), ("by-4.0_perm1", 1, 1.0)}
    assert {(r.k, r.error) for r in out if r.error} == {(2, "RuntimeError: negative")}
    for bad in ({}, {"by": 1, "no": 2}):
        with pytest.raises(TypeError):
            batch.run(frame, "k", halve, {"x": bad}, "half double")
    assert batch.across({"a": [1], "b": [2, 3]}, {"a": 0, "b": 0}) == {"a-1_combo0": {"a": 1, "b": 0}, "b-2_combo1": {"a": 0, "b": 2}, "b-3_combo2": {"a": 0, "b": 3}}
    with pytest.raises(ValueError):
        batch.finished(batch.run(frame.where("k = 2"), "k", halve, {"x": {"by": 2.0}}, "half double"))


def test_simulated_source_and_preprocessing(spark):
    recordings.register(spark)
    s = spark.read.format("simulated_recordings").option("recordings", 2).option("seconds", 60).load()
    assert s.count() == 2400 and s.where("label = 'event'").count() == 24
    for reference, fit, how in (("raw_isosbestic", "IRLS", "dF/F"), (None, "bleaching", "dB/B")):
        out = experiment.preprocess(s, "recording_id", "t", "raw_signal", reference, fit=fit, correction=how, normalisation="zscore").toPandas()
        assert len(out) == 2400 and abs(out.groupby("recording_id")["processed"].std(ddof=0) - 1).max() < 1e-9
    with pytest.raises(ValueError):
        experiment.preprocess(s, "recording_id", "t", "raw_signal", None, fit="OLS")
    assert experiment.grid(-1, 2, 10) == (-10, 20)


def test_csv_flags_take_counts(spark, tmp_path):
    (tmp_path / "r.csv").write_text("time,sig,cue\n0,1,0\n1,1,2\n2,1,\n3,1,True\n4,1,0.0\n5,1,False\n6,1,1\n")
    _, _, found = recordings.read_csv(spark, str(tmp_path / "r.csv"), "time", "sig", events=["cue"])
    assert sorted(r.t for r in found.collect()) == [1.0, 3.0, 6.0]
