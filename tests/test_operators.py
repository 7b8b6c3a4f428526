from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialforge.functions import vec
from trialforge.operators import peaks, recording, relational, trials, windowing
from trialforge.plans.queries import r


def rows(df, *cols):
    return sorted(tuple(x[c] for c in cols) for x in df.collect())


def test_interval_picks(spark):
    left = spark.createDataFrame([(1, 0, 0.5, 2.0), (1, 1, 4.0, 6.0), (1, 2, 7.0, 8.0), (1, 3, 9.0, 1.0)], "k int, o int, lo double, hi double")
    right = spark.createDataFrame([(1, 1.0), (1, 1.5), (1, 2.0), (1, 5.0)], "k int, at double")
    j = relational.interval_join(left, right, "k", "lo", "hi", "at", 2.0)
    assert rows(relational.pick(j, ["o"], "at", "first", "v"), "o", "v")[:2] == [(0, 1.0), (1, 5.0)]
    assert {r.o: r.v for r in relational.pick(j, ["o"], "at", "last", "v").collect()} == {0: 2.0, 1: 5.0, 2: None, 3: None}
    assert {r.o: r.v for r in relational.pick(j, ["o"], "at", "mean", "v").collect()} == {0: 1.5, 1: 5.0, 2: None, 3: None}


def test_nearest_takes_the_earlier_of_equals(spark):
    s = spark.createDataFrame([(1, i, float(i)) for i in range(4)], "k int, i int, t double")
    a = spark.createDataFrame([(1, 0.5), (1, 2.6), (1, -3.0), (1, 9.0)], "k int, q double")
    assert rows(relational.nearest(a, s, "k", "q", "t", "i"), "q", "near_id") == [(-3.0, 0), (0.5, 0), (2.6, 3), (9.0, 3)]


def test_pooled_alignment_ties(spark):
    e = spark.createDataFrame([(1, 0, "a", 10.0), (1, 1, "a", 20.0), (1, 2, "b", 10.0), (1, 3, "b", 15.0)], "user_id int, event_id int, event_type string, t double")
    got = windowing.alignments(e, ["b", "a"]).orderBy("trial_ord").collect()
    assert [r.align_event for r in got] == ["b", "a", "b", "a"]
    with pytest.raises(ValueError):
        windowing.alignments(e, [])


def test_corrections(spark):
    df = spark.createDataFrame([(2.0, 1.0), (4.0, 2.0)], "s double, r double")
    for how, expected in (("dF", [1, 2]), ("dF/F", [1, 1]), ("none", [2, 4])):
        assert [x[0] for x in df.select(recording.corrected(F.col("s"), F.col("r"), how)).collect()] == expected


def test_windows_drop_and_grid(spark):
    t = spark.createDataFrame([(k, float(c), [float(i) for i in range(20)]) for k, c in enumerate((1, 10, 18))], "k int, c double, x array<double>")
    got = trials.rewindow(t, F.col("c"), (-2.0, 2.0), 1.0, 20).collect()
    assert [r.k for r in got] == [1, 2] and all(len(r.x) == 4 for r in got)
    with pytest.raises(ValueError):
        trials.rewindow(t, F.col("c"), (-2.0, 2.0), 1.0, 20, policy="error")
    assert trials.rewindow(t.where("k = 1"), F.col("c"), (-1.0, 2.0), 1.0, 20, how="interp").collect()[0].x == [9.0, 10.0, 11.0]


def test_vectors(spark):
    df = spark.createDataFrame([([0.0, 1.0, 3.0, 6.0], [1.0, None, 3.0])], "x array<double>, y array<double>")
    got = df.select(vec.difference(F.col("x"), 1).alias("a"), vec.difference(F.col("x"), 2).alias("b"), vec.mean(F.col("y")).alias("m"), vec.median(F.col("x")).alias("d"), vec.trapezoid(F.col("x")).alias("t"), vec.block_mean(F.col("x"), 3).alias("k")).first()
    assert (got.a, got.b, got.m, got.d, got.t, got.k) == ([0, 1, 2, 3], [0, 1, 1, 1], 2.0, 2.0, 7.0, [4 / 3])


def test_peaks_merge_size_and_filters(spark):
    x = [0.0, 2.0, 2.0, 0.0, 2.0, 2.0, 0.0]
    t = spark.createDataFrame([(0, x)], "k int, x array<double>")
    found = peaks.threshold_runs(t, "k", threshold=1.0, center="zero", scale="one")
    assert rows(found, "start", "stop") == [(1, 2), (4, 5)]
    one = peaks.sized(peaks.merged_close(found, "k", 1), 2, 6)
    assert rows(one, "start", "stop") == [(1, 5)]
    m = peaks.metrics(one, t, "k").first()
    assert (m.peak_idx, m.height, m.duration, m.area) == (1, 2.0, 4.0, 6.0)
    p = spark.createDataFrame([(1, 5, 2.0), (0, 4, 4.0), (0, 1, 2.0), (1, 2, 3.0)], "k int, start int, v double")
    assert rows(peaks.filter_peaks(p, "k", "v", "lowest"), "k", "v") == [(0, 2.0), (1, 2.0)]
    assert rows(peaks.filter_peaks(p, "k", "v", "closest", 3.0), "k", "v") == [(0, 2.0), (1, 3.0)]
    assert rows(peaks.filter_peaks(p, "k", "v", "between", (2.0, 3.0)), "k", "v") == [(0, 2.0), (1, 2.0), (1, 3.0)]
    with pytest.raises(KeyError):
        peaks.filter_peaks(p, "k", "nothing", "lowest")


def test_order_of_rows_and_partitions_do_not_matter(spark):
    s = spark.createDataFrame([(k % 3, k, float(k * 7 % 11)) for k in range(60)], "user_id int, idx long, value double")
    a = rows(recording.mad_scores(s, ["user_id"], "value"), "user_id", "idx", "score")
    b = rows(recording.mad_scores(s.orderBy(F.rand(1)).repartition(7), ["user_id"], "value"), "user_id", "idx", "score")
    assert a == b


def test_registry(spark):
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 60


def test_artifact_amplitude_is_the_farthest_and_of_two_the_earlier(spark):
    y = {1: [0.0, 0.0, -3.0, 3.0, 0.0, 0.0], 2: [0.0, 0.0, 2.0, -5.0, 0.0, 1.0], 3: [0.0, 0.0, None, None, 0.0, 0.0], 4: [0.0, 0.0, None, 4.0, 4.0, 0.0]}
    s = spark.createDataFrame([(k, i, i / 10, v) for k, own in y.items() for i, v in enumerate(own)], "k int, idx int, t double, v double")
    found = spark.createDataFrame([(k, 2, 4) for k in y] + [(9, 2, 4), (1, 30, 40)], "k int, start int, stop int")
    got = {r.k: r for r in peaks.artifact_metrics(found, s, "k", "idx", "t", "v", 2).collect()}
    # the buffer before ends with the first sample of the interval
    assert {k: (r.before, r.amplitude) for k, r in got.items()} == {1: (-1.5, 4.5), 2: (1.0, -6.0), 3: (0.0, None), 4: (0.0, 4.0)}
    level = s.withColumn("v", F.when((s.k == 1) & (s.idx < 3), s.idx - 1.0).otherwise(s.v))  # 0 and 1 before, then 0: both half a unit from the level
    assert peaks.artifact_metrics(found.where("k = 1 and start = 2"), level.withColumn("v", F.when(F.col("idx") == 3, F.lit(0.0)).otherwise(F.col("v"))), "k", "idx", "t", "v", 2).first().amplitude == 0.5


def test_artifact_types_equal_their_sql_to_the_last_bit(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as e

    own, to = "/root/testdata/sf0.1/events.parquet", f"{tmp_path}/events.parquet"
    # a recording whose chunks differ in the last bit only, one where most differences are 0, and a constant
    long = f"SELECT event_id + 100000 * k AS event_id, ts + k * INTERVAL 30 DAY AS ts, user_id, event_type, value, props FROM '{own}', range(12) r(k) WHERE user_id = 105"
    flat = f"SELECT event_id + 100000 * k AS event_id, ts, user_id, event_type, CASE WHEN user_id = 107 THEN 5.0 ELSE value END AS value, props FROM '{own}', range(4) r(k) WHERE user_id IN (106, 107)"
    duckdb.sql(f"COPY ({long} UNION ALL {flat}) TO '{to}' (FORMAT parquet)")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{to}'")
    for name in ("artifact_types", "mad_score"):
        want = Counter(map(repr, con.sql(e.oracle_sql()[name]).fetchall()))
        assert Counter(repr(tuple(r)) for r in e.queries()[name](spark, str(tmp_path)).collect()) == want and len(want) > 20
    x = np.random.default_rng(1).integers(-500_000, 500_000, 20_000) / 10_000 + 0.00005
    want = [v for (v,) in con.sql("SELECT round(x, 4) + 0.0 FROM (SELECT unnest($1::DOUBLE[]) AS x)", params=[x.tolist()]).fetchall()]
    assert [v for (v,) in spark.createDataFrame([(float(v),) for v in x], "x double").select(r("x", 4)).collect()] == want
