"""Writing recordings and trials: Parquet with an axis table, wide and long exports, CSV and the text form."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_trials(trials: DataFrame, path: str, axis: list[float], meta: dict | None = None, mode: str = "errorifexists") -> None:
    """The trial matrix, its time axis and its metadata as three tables below ``path``."""
    spark = trials.sparkSession
    trials.write.mode(mode).parquet(f"{path}/trials")
    spark.createDataFrame([(i, float(t)) for i, t in enumerate(axis)], "time_idx int, time double").coalesce(1).write.mode(mode).parquet(f"{path}/axis")
    spark.createDataFrame([(json.dumps(meta or {}),)], "meta string").write.mode(mode).parquet(f"{path}/meta")


def read_trials(spark: SparkSession, path: str) -> tuple[DataFrame, list[float], dict]:
    axis = [r.time for r in spark.read.parquet(f"{path}/axis").orderBy("time_idx").collect()]  # one short axis
    return spark.read.parquet(f"{path}/trials"), axis, json.loads(spark.read.parquet(f"{path}/meta").first().meta)


def append_trials(trials: DataFrame, path: str, axis: list[float], tol: float = 1e-6) -> None:
    """Appends trials on the same axis (within ``tol``, else ValueError); the commit protocol leaves nothing of a failed write."""
    spark = trials.sparkSession
    old, known, _ = read_trials(spark, path)
    if len(known) != len(axis) or any(abs(a - b) > tol for a, b in zip(known, axis, strict=True)):
        raise ValueError("the time axes differ")
    if sorted(old.columns) != sorted(trials.columns):
        raise ValueError("the columns differ")
    trials.select(*old.columns).write.mode("append").parquet(f"{path}/trials")


def wide(samples: DataFrame, events: DataFrame, key: str, t: str, label: str, labels: list[str]) -> DataFrame:
    """Samples with one flag per label, true at the sample nearest to an event (ties to the earlier)."""
    from ..operators.relational import nearest

    marks = events.where(F.col(label).isin(labels)).select(key, F.col(t).alias("_q"), F.col(label).alias("_label"))
    flags = nearest(marks, samples, key, "_q", t, "idx").groupBy(key, F.col("near_id").alias("idx")).pivot("_label", labels).agg(F.lit(True))
    out = samples.join(flags, [key, "idx"], "left")
    return out.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit(False)) for c in labels})


def long(samples: DataFrame, ids: list[str], traces: list[str]) -> DataFrame:
    """``source, value`` rows of the traces that exist."""
    return samples.unpivot(ids, [c for c in traces if c in samples.columns], "source", "value")


def write_csv(frame: DataFrame, path: str, shape: str = "wide", ids: list[str] | None = None, traces: list[str] | None = None) -> None:
    if shape not in ("wide", "long"):
        raise ValueError(f"unknown format {shape}")
    (frame if shape == "wide" else long(frame, ids or [], traces or [])).write.mode("errorifexists").csv(path, header=True)


def append_csv(frame: DataFrame, path: str) -> None:
    """Appends to a folder of CSV files; the headers must be equal."""
    known = frame.sparkSession.read.csv(path, header=True).columns
    if known != frame.columns:
        raise ValueError(f"columns {frame.columns} do not match {known}")
    frame.write.mode("append").csv(path, header=True)


def write_text_dict(data: dict, path: str) -> None:
    """Nested dictionary as tab-indented ``key: value`` lines."""

    def lines(d: dict, depth: int):
        for k, v in d.items():
            if isinstance(v, dict):
                yield "\t" * depth + f"{k}:"
                yield from lines(v, depth + 1)
            else:
                yield "\t" * depth + f"{k}: {v}"

    Path(path).write_text("\n".join(lines(data, 0)) + "\n", encoding="utf-8")
