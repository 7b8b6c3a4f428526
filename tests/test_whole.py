"""Queries that do the whole job, against brute force over the tables."""

from collections import Counter

import numpy as np
import pytest

import __spark_entry__
from trialforge import sim
from trialforge.kernels import special
from trialforge.operators import comparison, experiment, trials

SF = "/root/testdata/sf0.001"


def run(spark, name):
    return __spark_entry__.queries()[name](spark, SF)


def test_long_traces_of_every_supplier(spark):
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").toPandas()
    want = Counter((o, n, c, v) for c in ("l_quantity", "l_extendedprice", "l_discount") for o, n, v in zip(rows.l_orderkey, rows.l_linenumber, rows[c], strict=True))
    assert rows.l_suppkey.max() > 5 and Counter(tuple(r) for r in run(spark, "unpivot_traces").collect()) == want


def test_wide_form_has_every_point(spark):
    want = {r.vec_id: (r.label, *map(float, r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    got = run(spark, "to_wide")
    assert got.columns == ["vec_id", "label"] + [f"t_{k}" for k in range(1, 65)]
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want
    ragged = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0, 3.0]), (2, None)], "k int, x array<double>")
    assert sorted(map(tuple, trials.to_wide(ragged, ["k"]).collect())) == [(0, 1.0, None, None), (1, 1.0, 2.0, 3.0), (2, None, None, None)]


def test_long_form_of_every_trial(spark):
    own = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    want = {(r.vec_id, k, float(v)) for r in own for k, v in enumerate(r.embedding)}
    assert {tuple(r) for r in run(spark, "to_long").collect()} == want and len({r.label for r in own}) > 1
    assert {r.vec_id for r in run(spark, "filter_trials").collect()} == {r.vec_id for r in own if r.label == 3}


def test_event_kernels_keep_their_tails(spark):
    t = np.arange(20_000) / 20
    g = 0.02 * (t / 2) ** 2 * np.exp(2 - t)
    taps = np.flatnonzero(g > 1e-4 * g.max())[-1] + 1
    assert sim.kernel_taps(spark, 20, sim.gamma_kernel) == taps and 15 < taps / 20 < 16
    want = np.zeros(600)
    for first in (40, 70, 201):
        want[first : first + taps] += g[:taps]
    got = np.array([r.event for r in run(spark, "sim_event_kernel").orderBy("idx").collect()])
    assert np.abs(got - want).max() < 1e-8 and got[201 + 200] > 0
    assert sim.kernel_taps(spark, 20, lambda t: sim.exp_kernel(t, -1.0, 1.0)) == 185
    with pytest.raises(ValueError):
        sim.kernel_taps(spark, 20, lambda t: sim.exp_kernel(t, 1.0, 500.0))


def test_permutations_and_critical_t_are_the_defaults(spark):
    rng = np.random.default_rng(4)
    a, b = rng.standard_normal((9, 20)), 2 * rng.standard_normal((14, 20))
    a[:, 5:9] += 3
    v, w = a.var(axis=0, ddof=1) / 9, b.var(axis=0, ddof=1) / 14
    t = special.t_critical(0.05, ((v + w) ** 2 / (v**2 / 8 + w**2 / 13)).mean())
    assert np.isclose(comparison.critical(a, b), t) and 2.0 < t < 2.3 and abs(special.t_critical(0.05, 10) - 2.2281389) < 1e-6
    frame = comparison.permutations(spark)
    assert frame.count() == frame.distinct().count() == 2000
    assert comparison.permutation_masses(a, b, frame.limit(50)).exceptAll(comparison.permutation_masses(a, b, frame.limit(50), t)).isEmpty()
    one = [tuple(r) for x in (None, t) for r in [comparison.cluster_depth(a, b, frame.where("perm < 50"), x).collect()]]
    assert one[0] == one[1] and {r.time_idx for r in one[0]} >= {5, 6, 7, 8}


def test_permutation_query_resolves_one_in_2000(spark):
    got = run(spark, "permutation_test").collect()
    own = {k: np.array([list(map(float, r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").where(f"label = {k}").orderBy("vec_id").collect()]) for k in (0, 1)}
    t, c = comparison.welch_t(own[0], own[1]), comparison.critical(own[0], own[1])
    assert {(r.sign, r.start, r.stop) for r in got} == {(s, x, y - 1) for s in (1, -1) for x, y in comparison.mask_runs(s * t > c)}
    x = np.vstack([own[0], own[1]])
    null = np.array([comparison.max_mass(*np.split(x[np.random.default_rng([42, k]).permutation(len(x))], [len(own[0])]), c) for k in range(2000)])
    assert got and all(np.isclose(r.p, (null >= r.mass).mean(), atol=1e-3) for r in got)


def test_a_cutoff_beyond_the_sampling_is_an_error(spark):
    s = spark.createDataFrame([(1, k / 6, float(k % 5), float(k % 7)) for k in range(60)], "k int, t double, y double, x double")
    with pytest.raises(Exception, match="samples a second"):
        experiment.preprocess(s, "k", "t", "y", "x", cutoff=3.1).collect()
    assert experiment.preprocess(s, "k", "t", "y", "x", cutoff=2.0).count() == experiment.preprocess(s, "k", "t", "y", "x", cutoff=None).count() == 60
    assert experiment.preprocess(s.limit(1), "k", "t", "y", "x").count() == 1
