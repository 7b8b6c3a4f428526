import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from trialforge.kernels import special
from trialforge.operators import comparison, peaks, recording, relational


def test_bh_skips_missing(spark):
    df = spark.createDataFrame([(1, 0.01), (1, 0.02), (1, None), (1, None), (2, float("nan")), (2, 0.5)], "g int, p double")
    got = sorted((r.g, r.p_adj if r.p is not None and r.p == r.p else None) for r in relational.bh_adjust(df, ["g"], "p").where("p_adj is not null").collect())
    assert got == [(1, pytest.approx(0.02)), (1, pytest.approx(0.02)), (2, 0.5)]
    assert relational.bh_adjust(df, ["g"], "p").where("p_adj is null").count() == 3
    by = [r.p_adj for r in relational.bh_adjust(df.where("p < 1"), ["g"], "p", "by").where("g = 1").collect()]
    assert by == [pytest.approx(0.03), pytest.approx(0.03)]


def test_left_interval_join_keeps_each_interval_once(spark):
    left = spark.createDataFrame([(1, 0, 0.5, 9.5), (1, 1, 20.0, 29.0), (1, 1, 20.0, 29.0), (2, 2, None, 4.0)], "k int, o int, lo double, hi double")
    right = spark.createDataFrame([(1, 5.0), (3, 1.0)], "k int, at double")
    got = relational.interval_join(left, right, "k", "lo", "hi", "at", 1.0, "left").collect()
    assert sorted((r.o, r["at"]) for r in got if r["at"] is not None) == [(0, 5.0)]
    assert sorted(r.o for r in got if r["at"] is None) == [1, 1, 2]


def test_spearman_drops_incomplete_pairs(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (1, 2.0, 2.0), (1, 3.0, None), (1, 4.0, 4.0)], "g int, x double, y double")
    r = recording.spearman(df, ["g"], "x", "y").first()
    assert (r.rho, r.n) == (pytest.approx(1.0), 3)


def test_spearman_deals_groups_to_tasks_by_rows(spark):
    df = spark.range(4000).select((F.col("id") % 40).alias("g"), (F.col("id") * 7 % 13).alias("x"), (F.col("id") * 11 % 17).alias("y"))
    many = recording.spearman(df, ["g"], "x", "y", recording.tasks_for(df, 500))
    assert many.rdd.getNumPartitions() == 9  # small shuffles are joined to fewer otherwise
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, recording.spearman(df, ["g"], "x", "y").collect()))
    assert recording.tasks_for(df.limit(0)) == 1
    lines = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet")
    assert __spark_entry__.queries()["spearman_by_group"](spark, "/root/testdata/sf0.1").rdd.getNumPartitions() == recording.tasks_for(lines) == 3


def test_welch_counts_known_values(spark):
    a = np.array([[1.0, 2], [2, 3], [np.nan, 4], [3, 5]])
    b = np.array([[5.0, 1], [6, 2], [7, 3], [np.nan, 4]])
    x, y = a[:, 0][~np.isnan(a[:, 0])], b[:, 0][~np.isnan(b[:, 0])]
    want = (x.mean() - y.mean()) / np.sqrt(x.var(ddof=1) / 3 + y.var(ddof=1) / 3)
    assert comparison.welch_t(a, b)[0] == pytest.approx(want)


def test_nearest_in_a_long_recording(spark):
    n = 100_000
    s = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("i"), (F.col("id") * 0.01).alias("t"))
    q = spark.range(1000).select(F.lit(1).alias("k"), (F.col("id") * 0.997 + 0.004).alias("q"))
    got = relational.nearest(q, s, "k", "q", "t", "i").collect()
    assert len(got) == 1000 and all(abs(r.near - r.q) <= 0.005 + 1e-9 for r in got)


def test_step_down_of_unreached_depths():
    null = np.array([[1.0, 0, 3], [2, 0, 1], [0.5, 0, 2], [4, 0, 1]])
    assert comparison.step_down(np.array([3.0, 2.0, 2.5]), null).tolist() == pytest.approx([0.5, 0.25, 0.25])  # p may fall, and the unreached depth takes the least
    assert comparison.step_down(np.array([3.0]), np.zeros((4, 1))).tolist() == [1.0]


def test_array_tails_equal_the_scalar_ones():
    t, df = np.array([0.0, 1.5, -3.0, 40.0]), np.array([3.0, 7.5, 30.0, 2.0])
    assert special.t_two_sided_all(t, df) == pytest.approx([special.t_two_sided(a, b) for a, b in zip(t, df, strict=True)], rel=1e-12)
    assert special.f_upper_all(np.array([4.0, 0.5]), np.array([2, 3]), np.array([10, 20])) == pytest.approx([special.f_upper(4.0, 2, 10), special.f_upper(0.5, 3, 20)], rel=1e-12)
    assert np.isnan(special.t_two_sided_all(np.array([np.nan]), np.array([2.0]))[0])


def test_anova_types(spark):
    rng = np.random.default_rng(3)
    rows = [(a, b, float(1 + 2 * (a == "x") + (b == "q") + 0.5 * (a == "x") * (b == "q") + rng.normal())) for a in "xyz" for b in "pq" for _ in range(3 + (a == "x") * 2)]
    df = spark.createDataFrame(rows, "a string, b string, y double")

    def rss(*terms):
        cols = [np.ones(len(rows))]
        a = np.array([[r[0] == v for v in "xy"] for r in rows], float) - np.array([[r[0] == "z"] for r in rows], float)
        b = np.array([[1.0 if r[1] == "p" else -1.0] for r in rows])
        for t in terms:
            cols += list(({"a": a, "b": b, "ab": a * b}[t]).T)
        x, y = np.array(cols).T, np.array([r[2] for r in rows])
        return ((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum()

    want = {1: (rss() - rss("a"), rss("a") - rss("a", "b")), 2: (rss("b") - rss("a", "b"), rss("a") - rss("a", "b")), 3: (rss("b", "ab") - rss("a", "b", "ab"), rss("a", "ab") - rss("a", "b", "ab"))}
    for kind, (sa, sb) in want.items():
        got = {r.source: r for r in comparison.anova(df, "y", ["a", "b"], kind).collect()}
        assert (got["a"].ss, got["b"].ss, got["residual"].ss) == pytest.approx((sa, sb, rss("a", "b", "ab")))
        assert got["a"].df == 2 and got["a * b"].df == 2 and 0 <= got["a"].p <= 1
    one = comparison.anova_oneway(df, "y", "a").first()
    assert one.p == pytest.approx(special.f_upper(one.f, one.df1, one.df2))


def test_pointwise_permutation(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(12, 6)), rng.normal(size=(10, 6))
    a[:, 2] += 4
    got = {r.time_idx: r.p for r in comparison.pointwise_permutation(a, b, comparison.permutations(spark, 300)).collect()}
    assert got[2] < 0.02 and sum(p > 0.05 for k, p in got.items() if k != 2) >= 4


def test_trims(spark):
    s = spark.createDataFrame([(1, i, float(i)) for i in range(6)], "k int, idx int, t double")
    with pytest.raises(ValueError):
        recording.trim_index(s, 0, 7, key="k")
    with pytest.raises(ValueError):
        recording.trim_time(s, 3.0, 1.0)
    ev = spark.createDataFrame([(1, 0.5), (1, 4.0), (1, 5.5)], "k int, t double")
    assert [r.t for r in recording.trim_events(ev, recording.trim_time(s, 1.0, 4.0), "k").collect()] == [4.0]
