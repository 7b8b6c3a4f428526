"""Reading recordings: CSV folders, annotations, the tab-indented text form, and a simulated data source."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..operators.recording import frequency

#: Texts of a flag that is off; a number is off if it is zero, anything else is on.
OFF = ("", "false", "nan")


def read_csv(spark: SparkSession, path: str | list[str], time: str, signal: str, isosbestic: str | None = None, events: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Recordings, samples and events of CSV files, one recording per file.

    Event columns are flags: zero, blank and false are off, any other value
    (such as a count) is on.  A missing signal column is a ValueError, a missing time or event column a
    KeyError, a missing isosbestic column makes a single channel.  The files
    must share their columns; ``idx`` follows the time, not the place in a file,
    so files may be split over tasks.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False, enforceSchema=False)
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    if signal not in raw.columns:
        raise ValueError(f"no signal column {signal}")
    for c in [time, *(events or [])]:
        if c not in raw.columns:
            raise KeyError(c)
    has_iso = isosbestic is not None and isosbestic in raw.columns
    text = lambda c: F.lower(F.trim(F.col(f"`{c}`")))
    flags = [F.coalesce(~text(c).isin(*OFF) & ~F.coalesce(text(c).try_cast("double") == 0, F.lit(False)), F.lit(False)).alias(c) for c in events or []]
    source = F.col("_metadata.file_path").alias("source")
    typed = raw.select(source, F.col(f"`{time}`").cast("double").alias("t"), F.col(f"`{signal}`").cast("double").alias("raw_signal"), (F.col(f"`{isosbestic}`").cast("double") if has_iso else F.lit(None).cast("double")).alias("raw_isosbestic"), *flags)
    samples = typed.select("source", (F.row_number().over(Window.partitionBy("source").orderBy("t")) - 1).cast("long").alias("idx"), "t", "raw_signal", "raw_isosbestic")
    marked = F.filter(F.array(*[F.when(F.col(f"`{c}`"), F.lit(c)) for c in events]), lambda v: v.isNotNull()) if events else F.array().cast("array<string>")
    found = typed.select("source", F.explode(marked).alias("label"), "t")
    return frequency(typed, "source"), samples, found


def read_annotation(path: str | None, handler: str | Callable[[str], dict] = "json", parent_key: str | None = None) -> dict:
    """One annotation file as a dictionary; ``None`` gives an empty one, anything unreadable a ValueError."""
    if path is None:
        return {}
    if not os.path.isfile(path):
        raise ValueError(f"no file {path}")
    if callable(handler):
        got = handler(path)
    elif handler == "json":
        got = json.loads(Path(path).read_text(encoding="utf-8-sig"))
    elif handler in ("yaml", "yml"):
        import yaml

        got = yaml.safe_load(Path(path).read_text(encoding="utf-8-sig"))
    else:
        raise ValueError(f"unknown handler {handler}")
    if parent_key is not None:
        if not isinstance(got, dict) or parent_key not in got:
            raise ValueError(f"no key {parent_key}")
        got = got[parent_key]
    if not isinstance(got, dict):
        raise ValueError("an annotation must be a dictionary")
    return got


def read_annotations(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """JSON annotations of many recordings, a row a file, with their ``source``."""
    return spark.read.json(path, multiLine=True).select("*", F.col("_metadata.file_path").alias("source"))


def read_text_dict(path: str) -> dict:
    """The tab-indented text form: ``key: value`` lines, deeper tabs nest; values stay strings."""
    root: dict = {}
    stack = [root]
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        if not line.strip():
            continue
        depth = len(line) - len(line.lstrip("\t"))
        key, _, value = line.strip().partition(":")
        del stack[depth + 1 :]
        if value.strip():
            stack[-1][key.strip()] = value.strip()
        else:
            stack.append(stack[-1].setdefault(key.strip(), {}))
    return root


def discover(folder: str, kind: str = "file", pattern: str | None = None, recursive: bool = False) -> list[str]:
    """Files or folders below ``folder``, sorted."""
    if kind not in ("file", "folder"):
        raise ValueError(f"unknown kind {kind}")
    at = Path(folder)
    if not at.is_dir():
        raise ValueError(f"no folder {folder}")
    found = at.rglob(pattern or "*") if recursive else at.glob(pattern or "*")
    return sorted(str(p) for p in found if (p.is_file() if kind == "file" else p.is_dir()))


class SimulatedRecordings(DataSource):
    """Batch source ``simulated_recordings``: one partition per recording, seeded by its number.

    Options: ``recordings``, ``seconds``, ``frequency``, ``events`` and ``seed``.
    """

    @classmethod
    def name(cls) -> str:
        return "simulated_recordings"

    def schema(self) -> str:
        return "recording_id long, idx long, t double, raw_signal double, raw_isosbestic double, label string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SimulatedReader(self.options)


class _SimulatedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.n, self.seconds = int(options.get("recordings", 1)), float(options.get("seconds", 120))
        self.freq, self.events, self.seed = float(options.get("frequency", 20)), int(options.get("events", 12)), int(options.get("seed", 7))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(self.n)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        rng = np.random.default_rng([self.seed, partition.value])
        n = round(self.seconds * self.freq)
        t = np.arange(n) / self.freq
        onsets = set(np.linspace(0, n - 1, self.events + 2)[1:-1].astype(int).tolist())
        base = 50 * np.exp(-t / 300) + 20 * np.exp(-t / 10_000) + 10
        response = np.zeros(n)
        for o in onsets:
            d = t[o:] - t[o]
            response[o:] += 0.02 * (d / 2) ** 2 * np.exp(2 - d)
        signal = base * (1 + response) + 0.05 * rng.standard_normal(n)
        iso = 0.8 * base + 0.05 * rng.standard_normal(n)
        for i in range(n):
            yield (partition.value, i, float(t[i]), float(signal[i]), float(iso[i]), "event" if i in onsets else None)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SimulatedRecordings)


