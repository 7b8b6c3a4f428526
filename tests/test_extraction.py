import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialforge import simulation
from trialforge.kernels import signal, special
from trialforge.operators import artifacts, extraction, peaks, pointwise, trialset
from trialforge.plans import pipeline


@pytest.fixture(scope="module")
def recording(spark):
    n, f = 200, 10.0
    t = np.arange(n) / f
    y = np.sin(t) + 0.1 * t
    s = spark.createDataFrame([(1, i, float(t[i]), float(y[i])) for i in range(n)], "user_id int, idx long, t double, value double")
    ev = spark.createDataFrame([(1, 0, "a", 5.02), (1, 1, "a", 12.0), (1, 2, "b", 5.5), (1, 3, "b", 5.9), (1, 4, "c", 12.4), (1, 5, "a", 0.3)], "user_id int, event_id int, event_type string, t double")
    return s, ev, t, y


def test_extract_nearest_and_interp(recording):
    s, ev, t, y = recording
    near = extraction.extract(s, ev, "a", (-1.0, 1.0), 10.0, center_on="b", tolerances={"c": (0.0, 0.5)}, conflict="all")
    rows = near.trials.orderBy("trial_num").collect()
    assert [r.trial_num for r in rows] == [1, 2] and near.dropped.collect()[0].align_t == 0.3
    assert rows[0].x == pytest.approx(y[45:65].tolist()) and rows[1].x == pytest.approx(y[110:130].tolist())  # the first is centred on b
    assert rows[0].events == pytest.approx({"b": 0.0, "b_occurrence_#2": 0.4}) and rows[1].events == pytest.approx({"c": 0.4})
    got = extraction.extract(s, ev, ["a"], (-1.0, 1.0), 10.0, alignment="interp", baseline_bounds=(-1.0, 0.0), normalisation="zscore").trials.orderBy("trial_num").first()
    at = 5.02 - 1 + np.arange(20) / 10
    base = np.interp(5.02 - 1 + np.arange(10) / 10, t, y)
    assert got.x == pytest.approx(((np.interp(at, t, y) - base.mean()) / base.std()).tolist())
    times = extraction.extract(s, ev, [3.0, 8.0], (-1.0, 1.0), 10.0).trials.collect()
    assert {r.align_event for r in times} == {extraction.TIMES} and len(times) == 2


@pytest.mark.parametrize(("kind", "given"), [
    (KeyError, {"align_to": "nothing"}), (ValueError, {"align_to": []}), (KeyError, {"center_on": "nothing"}), (ValueError, {"normalisation": "mad"}), (ValueError, {"invalid": "error"}),
    (ValueError, {"trial_bounds": (1.0, -1.0)}), (ValueError, {"tolerances": {"c": (1.0, 0.0)}}), (ValueError, {"alignment": "other"}), (ValueError, {"trial_bounds": (-50.0, 50.0)}), (ValueError, {"align_to": ["a", 3.0]}),
])
def test_extract_errors(recording, kind, given):
    s, ev, _, _ = recording
    with pytest.raises(kind):
        extraction.extract(s, ev, **({"align_to": "a", "trial_bounds": (-1.0, 1.0), "freq": 10.0} | given))


def test_extract_overlap(spark, recording):
    s, ev, _, _ = recording
    more = ev.union(spark.createDataFrame([(1, 9, "d", 5.6)], ev.schema))
    with pytest.raises(ValueError):
        extraction.extract(s, more, "a", (-1.0, 1.0), 10.0, center_on=["b", "d"])
    got = extraction.extract(s, more, "a", (-1.0, 1.0), 10.0, center_on=["b", "d"], check_overlap=False).trials.orderBy("trial_num").first()
    assert got.start_time == pytest.approx(4.6)  # the last label that is there


def test_artifacts_are_labelled_and_mended(spark):
    rng = np.random.default_rng(1)
    n = 3000
    t = np.arange(n) / 20
    y = 0.01 * rng.standard_normal(n)
    y[500:504] += 3.0  # a spike
    y[1500:] += 2.0  # a jump
    y[2400:2403] -= 2.5
    s = spark.createDataFrame([(1, i, float(t[i]), float(y[i]), float(y[i] * 0.5)) for i in range(n)], "k int, i long, t double, v double, r double")
    found = artifacts.detect(s, "k", "i", "t", "v", expand=(5, 5), buffer=20, chunks=20, jump_score=10.0)
    got = {r.start // 100 * 100: r for r in found.collect()}
    assert set(got) == {400, 1400, 2300} and got[1400].type == "jump" and got[1400].baseline_change == pytest.approx(2.0, abs=0.1)
    assert artifacts.types(found) and artifacts.groups(found, "none").count() == 0
    assert artifacts.flagged(s, found, "k", "i").where("artifact").count() == sum(r.stop - r.start for r in got.values())
    told = found.withColumn("type", F.when(F.floor(F.col("start") / 100) == 14, "jump").otherwise("spike"))
    fixed = np.array([r.corrected for r in artifacts.correct(s, told, "k", "i", "t", "v", (5, 5), 20).orderBy("i").collect()])
    assert np.abs(fixed).max() < 0.3 and abs(fixed[2000:2300].mean()) < 0.05
    kept = artifacts.detect(s, "k", "i", "t", "v", "r", expand=(5, 5), buffer=20, chunks=20)
    assert kept.count() == 3 and all(r.reference_cor == pytest.approx(1.0) for r in kept.collect())
    assert artifacts.detect(s.withColumn("r", -F.col("v")), "k", "i", "t", "v", "r", expand=(5, 5), buffer=20, chunks=20).count() == 0


def test_one_call_corrects_many_recordings(spark):
    rng = np.random.default_rng(2)
    y = {k: np.round(rng.uniform(0, 9, n), 2) for k, n in [(None, 25), (1, 1), (2, 40), (3, 12), (4, 7), (5, 30)]}
    told = {None: [(3, 5, "spike"), (9, 11, "jump")], 2: [(0, 2, "jump"), (8, 9, "spike"), (20, 24, "jump"), (38, 40, "jump")], 4: [(2, 4, None), (5, 6, "spike")], 5: [(1, 2, "jump"), (10, 13, "jump")], 9: [(1, 2, "spike")]}
    want = {}
    for k, v in y.items():  # on whole signals
        for a, b, _ in [x for x in told.get(k, []) if x[2] == "spike"]:
            v = signal.fill(v, np.arange(len(v)) / 2, a, b, 4, 4)
        drift, jumps = np.zeros(len(v)), [x for x in told.get(k, []) if x[2] == "jump"]
        for a, b, _ in jumps:
            if len(v[b : b + 5]):
                drift[b:] += np.median(v[b : b + 5]) - np.median(v[max(0, a - 4) : a + 1])
        v = v - drift
        for a, b, _ in jumps:
            v = signal.fill(v, np.arange(len(v)) / 2, a, b, 4, 4)
        want |= {(k, i, i / 2): x for i, x in enumerate(v.tolist())}
    s = spark.createDataFrame([(k, i, i / 2, float(x)) for k, v in y.items() for i, x in enumerate(v)], "k long, i long, t double, v double").orderBy(F.rand(3))
    found = spark.createDataFrame([(k, *x) for k, own in told.items() for x in own], "k long, start long, stop long, type string").orderBy(F.rand(4))
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for rows in ("7", "10000"):  # recordings over several batches, and several in one
        spark.conf.set(size, rows)
        got = artifacts.correct(s, found, "k", "i", "t", "v", buffer=5)
        assert {(r.k, r.i, r.t): r.corrected for r in got.collect()} == want and got.count() == len(want)
    spark.conf.unset(size)
    assert "CoGroups" not in got._jdf.queryExecution().toString()  # one call for each recording


def test_trial_sets(spark):
    own = trialset.from_arrays(spark, [{"g": "u"}, {"g": "u"}, {"g": None}], [[1, 2, 3, 4], [3, 4, 5, 6], [0, 0, 0, 0]], [0.0, 0.5, 1.0, 1.5], {"e": [[1] * 4, [2] * 4, [3] * 4]}, {"a": 1, "b": 2})
    assert own.frequency == 2.0 and own.layer("e").columns == ["trial_ord", "g", "x"]
    got = own.collapse("g", "mean", {"std": "std", "top": F.max}, ["trial_ord"]).frame.collect()
    assert len(got) == 1 and got[0].x == [2, 3, 4, 5] and got[0]["std"] == [1.0] * 4 and got[0].top == [3, 4, 5, 6] and got[0].n == 2 and got[0].trial_ord_top == 1
    listed = own.with_frame(own.frame.withColumn("name", F.concat(F.lit("n"), "trial_ord"))).collapse("g", metrics={}, collapse_cols=["name"], ordinal="trial_ord").frame.first()
    assert listed.name == ["n0", "n1"] and listed.trial_ord == 0
    assert own.collapse(metrics={}).frame.first().n == 3
    both = own.combine([own.add_metadata({"b": 3})])
    assert both.frame.count() == 6 and both.metadata == {"a": 1}
    with pytest.raises(ValueError):
        own.combine([trialset.TrialSet(own.frame, (0.0, 1.0, 2.0, 3.0))])
    for bad in ({"data": [[1.0]]}, {"layers": {"e": [[1.0]]}}, {"axis": [0.0, 0.0, 1.0, 2.0]}):
        args = {"obs": [{"g": "u"}], "data": [[1, 2, 3, 4]], "axis": [0, 1, 2, 3]} | bad
        with pytest.raises(ValueError):
            trialset.from_arrays(spark, **args)
    with pytest.raises(KeyError):
        own.labels(["nothing"])
    with pytest.raises(KeyError):
        own.layer("nothing")
    cut = own.downsample(2)
    assert cut.axis == (0.25, 1.25) and cut.frame.orderBy("trial_ord").first().x == [1.5, 3.5]
    assert [r.v for r in own.add_obs({"v": [7, 8, 9]}).frame.orderBy("trial_ord").collect()] == [7, 8, 9]
    assert own.add_obs({}, ["none"]).frame.first().none is None
    assert trialset.area(own).frame.orderBy("trial_ord").first().auc == pytest.approx(3.75)
    assert own.to_long(["trial_ord"], err_layer="e").count() == 12 and len(own.to_wide(["trial_ord"], "e").columns) == 5


def test_pointwise_models(spark):
    rng = np.random.default_rng(2)
    rows = [(s, x, k, float(1 + 2 * x * (k == 1) + 0.5 * (s - 4.5) + 0.3 * rng.standard_normal())) for s in range(10) for x in (0.0, 1.0) for k in range(2) for _ in range(4)]
    long = spark.createDataFrame(rows, "subject int, x double, time_idx int, signal double")
    plain = {(r.time_idx, r.term): r for r in pointwise.fit(long, {"x": F.col("x")}).collect()}
    for k in range(2):
        d = np.array([(1.0, x, y) for _, x, kk, y in rows if kk == k])
        beta, rss = np.linalg.lstsq(d[:, :2], d[:, 2], rcond=None)[:2]
        se = np.sqrt(np.diag(np.linalg.inv(d[:, :2].T @ d[:, :2])) * rss[0] / (len(d) - 2))
        assert (plain[k, "x"].beta, plain[k, "x"].se) == pytest.approx((beta[1], se[1]))
        assert plain[k, "x"].upper == pytest.approx(beta[1] + special.t_critical(0.05, len(d) - 2) * se[1])
    mixed = {(r.time_idx, r.term): r for r in pointwise.fit(long, {"x": F.col("x")}, subject="subject").collect()}
    # balanced: the effect is that of the plain model, its error that within subjects
    d = np.array([(s, x, y) for s, x, kk, y in rows if kk == 1])
    within = d[:, 2].copy()
    for s in range(10):
        within[d[:, 0] == s] -= d[d[:, 0] == s, 2].mean()
    slope = mixed[1, "x"].beta
    sigma = np.sqrt(((within - slope * (d[:, 1] - 0.5)) ** 2).sum() / (len(d) - 10 - 1))
    assert slope == pytest.approx(plain[1, "x"].beta) and mixed[1, "x"].sigma == pytest.approx(sigma, rel=1e-4)
    assert mixed[1, "x"].se < plain[1, "x"].se / 2 and mixed[1, "x"].tau == pytest.approx(1.5, rel=0.4)
    axis = spark.createDataFrame([(0, 0.0)], "time_idx int, time double")
    out = pointwise.to_long(pointwise.fit(long, {"x": F.col("x")}), axis, ["x"]).orderBy("time_idx").collect()
    assert out[0].time == 0.0 and out[1].time is None and out[0].value == plain[0, "x"].beta
    with pytest.raises(KeyError):
        pointwise.term(pointwise.fit(long, {"x": F.col("x")}), "nothing")
    assert list(pointwise.dummies(long, "time_idx")) == ["time_idx1"]


def test_simulation(spark, tmp_path):
    own = simulation.from_parameters(length_sec=30, frequency=20, n_events=3, event_buffer_sec=2, spikes=1, jumps=1, jump_durations=(1.0, 2.0), movement_cutoff=1.0, dynamic_amplitude=0.01)
    a, b = own.render(), own.render()
    assert all((a[k] == b[k]).all() for k in a) and (own.render(1)["full_signal"] != a["full_signal"]).any()
    clean = ((a["photobleaching"] - 10) * a["neural_trace"] + a["photobleaching"]) * a["artifacts"]
    assert a["full_signal"] == pytest.approx(clean + a["noise"])
    assert set(simulation.long_form(own).layer) == set(simulation._CONDENSED) and len(simulation.long_form(own, ["events"], False, 2)) == 600
    assert simulation.experiment_table(own).trial_cue.sum() == 3
    more = own.with_relative_events("trial_cue", (0.5, 1.0), ["lick", "miss"], weights=[0.5, 0.5])
    assert sum(len(more.events[x].onsets) for x in ("lick", "miss")) == 3 and "lick" not in more.without_event("lick").events
    with pytest.raises(ValueError):
        own.with_event("late", [99.0]).render()
    with pytest.raises(ValueError):
        simulation.Event((1.0,), kernel=lambda t, a: a + 0 * t).response(10, 5)
    lib = simulation.Library({"length_sec": 20.0, "frequency": 10.0, "n_events": 2, "event_buffer_sec": 2.0, "movement": None}, {"event_amplitude": [0.1, 0.2]}, 2, 3)
    assert sorted(p["seed"] for p in lib.params) == [1, 2, 3, 4]
    lib.write(spark, str(tmp_path / "lib"))
    got = spark.read.parquet(str(tmp_path / "lib/recordings"))
    assert got.count() == 800 and got.where(F.size("labels") > 0).count() == 8
    with pytest.raises(TypeError):
        simulation.Library({"nothing": 1}, {})
    assert simulation.taper_end(np.ones(4), 2, "linear").tolist() == [1, 1, 1, 0]


def test_pipeline(spark, tmp_path):
    s = spark.createDataFrame([(k, i, float(i), f"m{k}") for k in range(3) for i in range(4 if k else 1)], "k int, i int, v double, mouse string")

    def load(p, least=2):
        if len(p) < least:
            raise ValueError("too short")
        return p

    plan = pipeline.Pipeline({"load": load, "sum": lambda p, by=1.0: p.assign(v=p["v"] * by).groupby("k", as_index=False)["v"].sum()}, "v double", {"load": lambda p: p[p["v"] > 0]}, lambda p: f"id{p['k'].iloc[0]}", ("mouse",))
    configs = {"one": {}, "two": {"sum": {"by": 2.0}}}
    got = plan.run(s, "k", configs)
    assert sorted((r.config, r.k, r.experiment_id, r.mouse, r.v) for r in got.where("error is null").collect()) == [("one", 1, "id1", "m1", 6.0), ("one", 2, "id2", "m2", 6.0), ("two", 1, "id1", "m1", 12.0), ("two", 2, "id2", "m2", 12.0)]
    assert {(r.k, r.stage, r.rows) for r in pipeline.status(got, "k").where("error is not null").collect()} == {(0, "load", 0)}
    plan.save(got, str(tmp_path / "out"), configs)
    assert pipeline.parameters(str(tmp_path / "out")) == configs and json.dumps(configs)
    with pytest.raises(Exception, match="already exists"):
        plan.save(got, str(tmp_path / "out"), configs)
    for bad in ({"x": {"nothing": {}}}, {"x": {"load": {"nothing": 1}}}):
        with pytest.raises((KeyError, TypeError)):
            plan.run(s, "k", bad)
    (tmp_path / "a.csv").write_text("x")
    assert pipeline.jobs(pipeline.inputs(str(tmp_path), pattern="*.csv"), lambda p: {"n": len(p)})[0]["options"]["n"] > 0
    with pytest.raises(ValueError):
        pipeline.inputs(str(tmp_path), pattern="*.none")


def test_peak_results(spark, tmp_path):
    m = spark.createDataFrame([(1, [0.0, 0.0, 5.0, 0.0, 0.0, 0.0, 6.0, 7.0, 0.0, 0.0]), (2, [0.0] * 10)], "t int, x array<double>")
    got = peaks.detected(m, "t", 2.0, threshold=2.0, direction="positive", center="zero", scale="one")
    assert [(r.start, r.stop, r.height) for r in got.collect()] == [(2, 2, 5.0), (6, 7, 7.0)]
    assert {r.t: r.n_peaks for r in peaks.peak_counts(m, got, "t").collect()} == {1: 2, 2: 0} and not peaks.one_per_trial(got, "t")
    assert peaks.detected(m, "t", 2.0, threshold=2.0, direction="positive", center="zero", scale="one", merge=1.5).count() == 1
    assert peaks.detected(m, "t", 2.0, threshold=2.0, direction="positive", center="zero", scale="one", shortest=1.0).count() == 1
    got.coalesce(1).write.csv(str(tmp_path / "p"), header=True)
    back = peaks.read_csv(spark, str(tmp_path / "p"), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in got.schema))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, got.collect()))


def test_preprocessing_detects_and_corrects(spark):
    rng = np.random.default_rng(3)
    n = 1200
    t = np.arange(n) / 20
    iso = 50 + 5 * np.exp(-t / 30) + 0.01 * rng.standard_normal(n)
    y = 1.2 * iso + 0.01 * rng.standard_normal(n)
    y[600:606] += 40.0
    s = spark.createDataFrame([(1, float(t[i]), float(y[i]), float(iso[i])) for i in range(n)], "k int, t double, y double, x double").cache()
    options = {"cutoff": None, "fit": "IRLS", "correction": "dF"}
    plain, none = artifacts.preprocessed(s, "k", "t", "y", "x", **options)
    assert none is None and plain.agg(F.max("processed")).first()[0] > 30
    detector = lambda p: artifacts.detect(p, "k", "idx", "t", "processed", expand=(3, 3), buffer=20, chunks=10).withColumn("type", F.lit("spike"))
    corrector = lambda p, f: artifacts.correct(p, f, "k", "idx", "t", "processed", (5, 5), 20)
    out, found = artifacts.preprocessed(s, "k", "t", "y", "x", detector, corrector, **options)
    assert [(r.start <= 600 and r.stop >= 606) for r in found.collect()] == [True]
    assert out.count() == n and out.agg(F.max(F.abs("processed"))).first()[0] < 1
