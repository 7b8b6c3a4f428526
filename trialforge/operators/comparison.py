"""Group comparison: Welch tests, clusters, permutation tests and analyses of variance."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernels import special
from .relational import islands

PERMUTATIONS = 2000


def welch(long: DataFrame, group: str, a: object, b: object, value: str = "signal", by: str = "time_idx") -> DataFrame:
    """Point-wise Welch t and degrees of freedom of group a against b; missing values are skipped."""
    s = long.where(F.col(group).isin([a, b])).groupBy(by)

    def part(g: object, f) -> object:
        return f(F.when(F.col(group) == g, F.col(value)))

    s = s.agg(*[f(F.when(F.col(group) == g, F.col(value))).alias(f"{n}{k}") for k, g in (("a", a), ("b", b)) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    va, vb = F.try_divide("va", "na"), F.try_divide("vb", "nb")
    t = F.try_divide(F.col("ma") - F.col("mb"), F.sqrt(va + vb))
    df = F.try_divide((va + vb) * (va + vb), va * va / (F.col("na") - 1) + vb * vb / (F.col("nb") - 1))
    return s.select(by, t.alias("t"), df.alias("df"))


def with_p(frame: DataFrame, t: str = "t", df: str = "df", name: str = "p") -> DataFrame:
    """Two-sided p-value of t, whole Arrow batches at once; null where t or its degrees of freedom are missing."""

    @F.pandas_udf("double")
    def p(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series(special.t_two_sided_all(t.to_numpy(float), df.to_numpy(float)))

    out = p(t, df)
    return frame.withColumn(name, F.when(~F.isnan(out), out))


def with_f_p(frame: DataFrame, f: str = "f", df1: str = "df1", df2: str = "df2", name: str = "p") -> DataFrame:
    """Upper-tail p-value of F."""

    @F.pandas_udf("double")
    def p(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
        return pd.Series(special.f_upper_all(f.to_numpy(float), df1.to_numpy(float), df2.to_numpy(float)))

    out = p(F.col(f).cast("double"), F.col(df1).cast("double"), F.col(df2).cast("double"))
    return frame.withColumn(name, F.when(~F.isnan(out), out))


def clusters(stats: DataFrame, threshold: float, stat: str = "t", by: str = "time_idx") -> DataFrame:
    """Runs beyond the threshold in either direction: ``start, stop, mass`` (inclusive).  One short axis, so one sort."""
    out = None
    for sign in (1, -1):
        flagged = islands(stats.withColumn("sign", F.lit(sign)), ["sign"], by, sign * F.col(stat) > threshold)
        found = flagged.groupBy("sign", "island").agg(F.min(by).alias("start"), F.max(by).alias("stop"), F.abs(F.sum(stat)).alias("mass")).drop("island")
        out = found if out is None else out.union(found)
    return out


def critical(a: np.ndarray, b: np.ndarray, p: float = 0.05) -> float:
    """Two-tailed critical t at the mean of the points' Welch degrees of freedom."""
    return special.t_critical(p, float(welch_df(a, b).mean()))


def matrices(trials: DataFrame, group: str, a: object, b: object, x: str = "x", order: str = "vec_id", limit: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """The trials of two groups of one experiment as matrices on the driver; an error beyond ``limit`` trials."""
    rows = trials.where(F.col(group).isin([a, b])).select(group, x, order)
    if rows.count() > limit:
        raise ValueError(f"more than {limit} trials")
    got = rows.orderBy(order).toPandas()
    return tuple(np.array(got.loc[got[group] == k, x].tolist(), float) for k in (a, b))


def cluster_p(seen: DataFrame, null: DataFrame, n: int) -> DataFrame:
    """Share of the ``n`` permutations (``null.mass``) of at least each observed cluster's mass.  The permutations' masses are one sorted array, so no cluster meets them in a join."""
    masses = F.broadcast(null.agg(F.sort_array(F.collect_list("mass")).alias("_null")))  # n doubles
    return seen.join(masses).withColumn("p", F.size(F.filter("_null", lambda v: v >= F.col("mass"))) / F.lit(float(n))).drop("_null")


def permutations(spark: SparkSession, n: int = PERMUTATIONS) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "perm").repartition(min(n, spark.sparkContext.defaultParallelism))


def permutation_masses(a: np.ndarray, b: np.ndarray, frame: DataFrame, threshold: float | None = None, seed: int = 42, p_threshold: float = 0.05) -> DataFrame:
    """Largest cluster mass of each permutation in ``frame.perm``; trials are shuffled on the workers, a seed per permutation.  Without a threshold it is the critical t of ``p_threshold``."""
    threshold = critical(a, b, p_threshold) if threshold is None else threshold
    rows, na = np.vstack([a, b]), len(a)
    shared = frame.sparkSession.sparkContext.broadcast(rows)  # one experiment's matrix

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x = shared.value
        for part in parts:
            got = [max_mass(*np.split(x[np.random.default_rng([seed, int(k)]).permutation(len(x))], [na]), threshold) for k in part["perm"]]
            yield pd.DataFrame({"perm": part["perm"], "mass": got})

    return frame.select("perm").mapInPandas(run, "perm long, mass double")


def welch_t(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Point-wise t; missing values are skipped."""
    na, nb = (~np.isnan(a)).sum(axis=0), (~np.isnan(b)).sum(axis=0)
    va, vb = np.nanvar(a, axis=0, ddof=1) / na, np.nanvar(b, axis=0, ddof=1) / nb
    return (np.nanmean(a, axis=0) - np.nanmean(b, axis=0)) / np.sqrt(va + vb)


def welch_df(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Degrees of freedom of each point; missing values are skipped."""
    na, nb = (~np.isnan(a)).sum(axis=0), (~np.isnan(b)).sum(axis=0)
    va, vb = np.nanvar(a, axis=0, ddof=1) / na, np.nanvar(b, axis=0, ddof=1) / nb
    return (va + vb) ** 2 / (va**2 / (na - 1) + vb**2 / (nb - 1))


def mask_runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """Half-open runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(int(s), int(e)) for s, e in edges.reshape(-1, 2)]


def max_mass(a: np.ndarray, b: np.ndarray, threshold: float) -> float:
    t = welch_t(a, b)
    return max((abs(float(t[s:e].sum())) for f in (t > threshold, t < -threshold) for s, e in mask_runs(f)), default=0.0)


def anova_oneway(frame: DataFrame, dv: str, between: str) -> DataFrame:
    """Sums of squares, degrees of freedom, mean squares, F and partial eta squared of one factor."""
    g = frame.groupBy(between).agg(F.count(dv).alias("n"), F.avg(dv).alias("m"), F.var_pop(dv).alias("v"))
    s = g.agg(F.sum(F.col("n")).alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"), F.sum(F.col("n") * F.col("v")).alias("within"))
    s = s.withColumn("ssb", F.col("q") - F.col("s") * F.col("s") / F.col("n")).withColumn("df1", F.col("k") - 1).withColumn("df2", F.col("n") - F.col("k"))
    f = F.try_divide(F.col("ssb") / F.col("df1"), F.col("within") / F.col("df2"))
    out = s.select(F.lit(between).alias("source"), F.col("ssb").alias("ss_between"), F.col("within").alias("ss_within"), "df1", "df2", f.alias("f"), F.try_divide(F.col("ssb"), F.col("ssb") + F.col("within")).alias("np2"))
    return with_f_p(out)


def anova_rm(cells: DataFrame, dv: str, within: str, subject: str) -> DataFrame:
    """Repeated-measures sums of squares over complete subject x level cells (averaged first)."""
    c = cells.groupBy(subject, within).agg(F.avg(dv).alias("y"))
    levels = c.select(within).distinct().count()
    whole = c.groupBy(subject).agg(F.count("*").alias("_k")).where(F.col("_k") == levels).drop("_k")
    c = c.join(whole, subject)
    sub = c.groupBy(subject).agg(F.avg("y").alias("m")).agg(F.count("*").alias("n"), F.var_pop("m").alias("vs"))
    lev = c.groupBy(within).agg(F.avg("y").alias("m")).agg(F.var_pop("m").alias("vl"))
    tot = c.agg(F.var_pop("y").alias("vt"))
    s = sub.crossJoin(lev).crossJoin(tot)  # three one-row frames
    n, k = F.col("n"), F.lit(levels)
    s = s.select((n * k * F.col("vl")).alias("ss_effect"), (n * k * F.col("vs")).alias("ss_subject"), (n * k * (F.col("vt") - F.col("vl") - F.col("vs"))).alias("ss_error"), (k - 1).cast("long").alias("df1"), ((n - 1) * (k - 1)).cast("long").alias("df2"))
    s = s.withColumn("f", F.try_divide(F.col("ss_effect") / F.col("df1"), F.col("ss_error") / F.col("df2"))).withColumn("ng2", F.try_divide("ss_effect", F.col("ss_effect") + F.col("ss_error") + F.col("ss_subject")))
    out = with_f_p(s.crossJoin(sphericity(c, "y", within, subject)))
    return with_f_p(out.withColumn("_d1", F.col("df1") * F.col("eps")).withColumn("_d2", F.col("df2") * F.col("eps")), "f", "_d1", "_d2", "p_gg").drop("_d1", "_d2")


def sphericity(cells: DataFrame, dv: str, within: str, subject: str, limit: int = 100) -> DataFrame:
    """Greenhouse-Geisser ``eps`` of complete subject x level cells, one row: from the covariances of the levels, of which there may be ``limit``."""
    levels = [r[0] for r in cells.select(within).distinct().orderBy(within).limit(limit + 1).collect()]
    if len(levels) > limit:
        raise ValueError(f"more than {limit} levels")
    wide = cells.groupBy(subject).agg(*[F.max(F.when(F.col(within) == v, F.col(dv))).alias(f"_l{k}") for k, v in enumerate(levels)])
    each = [F.covar_samp(f"_l{i}", f"_l{j}") for i in range(len(levels)) for j in range(len(levels))]
    got = np.array([float("nan") if x is None else x for x in wide.agg(*each).first()] if levels else [], float).reshape(len(levels), len(levels))
    eps = 1.0
    if len(levels) > 2:
        own = got - got.mean(0) - got.mean(1)[:, None] + got.mean()
        whole = float((own * own).sum())
        eps = float(np.trace(own) ** 2 / ((len(levels) - 1) * whole)) if whole > 0 else 1.0
    return cells.sparkSession.createDataFrame([(eps,)], "eps double")


def anova(frame: DataFrame, dv: str, between: list[str], ss_type: int = 2, limit: int = 10_000) -> DataFrame:
    """N-way analysis of variance of type 1, 2 or 3: ``source, ss, df, ms, f, p, np2``, the residual last.

    Rows are summed per cell first, map-side; the models are fitted to the at
    most ``limit`` cells on the driver, weighted by their counts, which gives
    the sums of squares of the rows.  Rows with a missing value go.
    """
    if ss_type not in (1, 2, 3):
        raise ValueError(f"unknown type {ss_type}")
    own = frame.where(F.col(dv).isNotNull())
    for c in between:
        own = own.where(F.col(c).isNotNull())
    cells = own.groupBy(*between).agg(F.count("*").alias("_n"), F.avg(dv).alias("_m"), (F.var_pop(dv) * F.count("*")).alias("_w")).limit(limit + 1).toPandas()
    if len(cells) > limit:
        raise ValueError(f"more than {limit} cells")
    n, m = cells["_n"].to_numpy(float), cells["_m"].to_numpy(float)
    coded = {}
    for c in between:  # effects coding
        levels = sorted(cells[c].unique(), key=str)
        x = np.zeros((len(cells), len(levels) - 1))
        for k, v in enumerate(levels[:-1]):
            x[cells[c] == v, k] = 1
        x[cells[c] == levels[-1]] = -1
        coded[c] = x
    terms = [t for k in range(1, len(between) + 1) for t in itertools.combinations(between, k)]

    def columns(term: tuple[str, ...]) -> np.ndarray:
        out = np.ones((len(cells), 1))
        for c in term:
            out = (out[:, :, None] * coded[c][:, None, :]).reshape(len(cells), -1)
        return out

    def rss(some: list[tuple[str, ...]]) -> tuple[float, int]:
        x = np.hstack([np.ones((len(cells), 1)), *[columns(t) for t in some]]) * np.sqrt(n)[:, None]
        y = m * np.sqrt(n)
        beta, _, rank, _ = np.linalg.lstsq(x, y, rcond=None)
        return float(((y - x @ beta) ** 2).sum()), int(rank)

    full, rank = rss(terms)
    error, df_error = full + float(cells["_w"].sum()), int(n.sum()) - rank
    out = []
    for k, term in enumerate(terms):
        if ss_type == 1:
            small, large = terms[:k], terms[: k + 1]
        elif ss_type == 2:
            small = [t for t in terms if not set(term) <= set(t)]
            large = [*small, term]
        else:
            small, large = [t for t in terms if t != term], terms
        (a, ra), (b, rb) = rss(small), rss(large)
        ss, df = max(a - b, 0.0), rb - ra
        f = (ss / df) / (error / df_error) if df and df_error > 0 and error > 0 else None
        p = float(special.f_upper_all(np.array([f]), np.array([df]), np.array([df_error]))[0]) if f is not None else None
        out.append((" * ".join(term), ss, df, ss / df if df else None, f, p, ss / (ss + error) if ss + error else None))
    out.append(("residual", error, df_error, error / df_error if df_error > 0 else None, None, None, None))
    return frame.sparkSession.createDataFrame(out, "source string, ss double, df int, ms double, f double, p double, np2 double")


def anova_mixed(cells: DataFrame, dv: str, between: str, within: str, subject: str) -> DataFrame:
    """One factor between subjects, one within, over complete subjects (cells averaged first): ``source, ss, df1, df2, f, np2, p`` of both factors and their interaction.

    Every sum of squares is a difference of sums s^2 / n of one grouping, so no
    means are joined back to the rows.
    """
    c = cells.groupBy(subject, between, within).agg(F.avg(dv).alias("_y"))
    k = c.select(within).distinct().count()
    whole = c.groupBy(subject).agg(F.count("*").alias("_k")).where(F.col("_k") == k).select(subject)
    c = c.join(whole, subject)

    def part(name: str, *by: str) -> DataFrame:
        g = c.groupBy(*by).agg(F.sum("_y").alias("_s"), F.count("*").alias("_n"))
        return g.agg(F.sum(F.col("_s") * F.col("_s") / F.col("_n")).alias("q"), F.count("*").alias("m")).withColumn("part", F.lit(name))

    parts = part("all").unionByName(part("g", between)).unionByName(part("l", within)).unionByName(part("gl", between, within)).unionByName(part("s", subject)).unionByName(part("y", subject, within))
    row = parts.groupBy().agg(*[F.max(F.when(F.col("part") == p, F.col(v))).alias(f"{v}_{p}") for p in ("all", "g", "l", "gl", "s", "y") for v in ("q", "m")])
    q, m = (lambda p: F.col(f"q_{p}")), (lambda p: F.col(f"m_{p}"))
    ss_b, ss_s, ss_w = q("g") - q("all"), q("s") - q("g"), q("l") - q("all")
    ss_i = q("gl") - q("g") - q("l") + q("all")
    ss_e = q("y") - q("s") - q("gl") + q("g")
    df_b, df_s, df_w = m("g") - 1, m("s") - m("g"), m("l") - 1

    def line(name: str, ss, df1, err, df2):
        return F.struct(F.lit(name).alias("source"), ss.alias("ss"), df1.alias("df1"), df2.alias("df2"), F.try_divide(ss / df1, err / df2).alias("f"), F.try_divide(ss, ss + err).alias("np2"))

    lines = F.array(line("between", ss_b, df_b, ss_s, df_s), line("within", ss_w, df_w, ss_e, df_s * df_w), line("interaction", ss_i, df_b * df_w, ss_e, df_s * df_w))
    return with_f_p(row.select(F.explode(lines).alias("r")).select("r.*"))


def depth_maxima(t: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Largest |t| at each depth of any cluster, counted from its head and from its tail."""
    head, tail = np.zeros(len(t)), np.zeros(len(t))
    for flags in (t > threshold, t < -threshold):
        for s, e in mask_runs(flags):
            values = np.abs(t[s:e])
            head[: e - s] = np.maximum(head[: e - s], values)
            tail[: e - s] = np.maximum(tail[: e - s], values[::-1])
    return head, tail


def step_down(observed: np.ndarray, null: np.ndarray) -> np.ndarray:
    """Troendle's step-down: from the largest down, each against the maxima of those not yet tested.  A depth that no permutation reaches takes the least p of the others (1 if there are none)."""
    reached = (null != 0).any(axis=0)
    out = np.ones(len(observed))
    if not reached.any():
        return out
    own, rest = observed[reached], null[:, reached]
    order = np.argsort(-own, kind="stable")
    most = np.maximum.accumulate(rest[:, order][:, ::-1], axis=1)[:, ::-1]
    p = np.empty(len(own))
    p[order] = (most >= own[order]).mean(axis=0)
    out[reached], out[~reached] = p, p.min()
    return out


def cluster_depth(a: np.ndarray, b: np.ndarray, frame: DataFrame, threshold: float | None = None, seed: int = 42, p_threshold: float = 0.05) -> DataFrame:
    """Cluster-depth test: a p-value for each point of each observed cluster, the larger of its head's and its tail's.

    Without a threshold it is the critical t of ``p_threshold``.

    Permutations in ``frame.perm`` run on the workers; two values a depth and
    permutation come back, which the axis and the permutations bound.
    """
    threshold = critical(a, b, p_threshold) if threshold is None else threshold
    rows, na = np.vstack([a, b]), len(a)
    spark = frame.sparkSession
    shared = spark.sparkContext.broadcast(rows)  # one experiment's matrix

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x = shared.value
        for part in parts:
            got = [depth_maxima(welch_t(*np.split(x[np.random.default_rng([seed, int(k)]).permutation(len(x))], [na])), threshold) for k in part["perm"]]
            yield pd.DataFrame({"head": [h.tolist() for h, _ in got], "tail": [t.tolist() for _, t in got]})

    null = frame.select("perm").mapInPandas(run, "head array<double>, tail array<double>").toPandas()
    heads, tails = (np.array(null[c].tolist()) for c in ("head", "tail"))
    t, out = welch_t(a, b), []
    for sign in (1, -1):
        for s, e in mask_runs(sign * t > threshold):
            y, n = np.abs(t[s:e]), e - s
            p = np.maximum(step_down(y, heads[:, :n]), step_down(y[::-1], tails[:, :n])[::-1])
            out += [(sign, s, e - 1, s + i, float(t[s + i]), float(p[i])) for i in range(n)]
    return spark.createDataFrame(out, "sign int, start int, stop int, time_idx int, t double, p double")


# -- point-wise tests --------------------------------------------------------------


def pointwise_permutation(a: np.ndarray, b: np.ndarray, frame: DataFrame, seed: int = 42, statistic: Callable[[np.ndarray, np.ndarray], np.ndarray] = welch_t) -> DataFrame:
    """Two-sided permutation p of each point: ``time_idx, t, p``; ``statistic`` maps two matrices to a value per point.

    Each permutation's counts of values at or beyond the observed ones, on either side, are summed on the workers' side; p is twice the smaller
    tail, with the observed arrangement counted in.
    """
    rows, na = np.vstack([a, b]), len(a)
    spark, seen = frame.sparkSession, statistic(a, b)
    shared = spark.sparkContext.broadcast(rows)  # one experiment's matrix

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, slack = shared.value, 1e-14 * np.abs(np.nan_to_num(seen))
        up, down, n = np.zeros(len(seen), np.int64), np.zeros(len(seen), np.int64), 0
        for part in parts:
            for k in part["perm"]:
                t = statistic(*np.split(x[np.random.default_rng([seed, int(k)]).permutation(len(x))], [na]))
                up, down, n = up + (t >= seen - slack), down + (t <= seen + slack), n + 1
        yield pd.DataFrame({"time_idx": np.arange(len(seen)), "up": up, "down": down, "n": n})

    sums = frame.select("perm").mapInPandas(run, "time_idx int, up long, down long, n long").groupBy("time_idx").agg(*[F.sum(c).alias(c) for c in ("up", "down", "n")])
    own = spark.createDataFrame([(k, None if np.isnan(v) else float(v)) for k, v in enumerate(seen)], "time_idx int, t double")
    p = F.least(F.lit(1.0), 2 * (F.least("up", "down") + 1) / (F.col("n") + 1))
    return own.join(sums, "time_idx").select("time_idx", "t", F.when(F.col("t").isNotNull(), p).alias("p"))


def any_significant(tested: DataFrame, cutoff: float = 0.05, p: str = "p") -> bool:
    """Whether a p is below the cutoff."""
    return bool(tested.where(F.col(p) < cutoff).limit(1).count())


def significant_at(tested: DataFrame, cutoff: float = 0.05, p: str = "p") -> DataFrame:
    """The rows whose p is at most the cutoff."""
    return tested.where(F.col(p) <= cutoff)


def group_means(long: DataFrame, group: str, value: str = "signal", by: str = "time_idx") -> DataFrame:
    """Mean and population deviation of each group at each point."""
    return long.groupBy(group, by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("n"))
