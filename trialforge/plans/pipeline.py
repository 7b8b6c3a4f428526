"""Pipelines of stages over recordings: jobs, hooks, ids, metadata, output rules and parameter records.

A job is one recording under one configuration.  Its stages run one after
another within a task group; a stage that raises ends its job alone and leaves
a status row that names it.
"""

from __future__ import annotations

import json
import traceback
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.recordings import discover
from .batch import check_arguments, finished

Stage = Callable[..., pd.DataFrame]


def inputs(folder: str, kind: str = "file", pattern: str | None = None, recursive: bool = False) -> list[str]:
    """The inputs of a run; none is a ValueError."""
    found = discover(folder, kind, pattern, recursive)
    if not found:
        raise ValueError(f"no inputs in {folder}")
    return found


def jobs(found: list[str], options: dict | list[dict] | Callable[[str], dict] | None = None) -> list[dict]:
    """``input, options``: the same options for all inputs, one for each in a list, or those that a function gives for its path."""
    if isinstance(options, list) and len(options) != len(found):
        raise ValueError(f"{len(options)} options for {len(found)} inputs")
    each = [options(p) if callable(options) else options[k] if isinstance(options, list) else options or {} for k, p in enumerate(found)]
    return [{"input": p, "options": dict(o)} for p, o in zip(found, each, strict=True)]


@dataclass(frozen=True)
class Pipeline:
    """``stages`` are named functions of a recording's rows; a hook of the same name runs after its stage.

    ``identify`` names a recording from its rows, ``passdown`` lists columns of
    the recording (its metadata) that its results repeat.
    """

    stages: dict[str, Stage]
    schema: str
    hooks: dict[str, Callable[[pd.DataFrame], pd.DataFrame]] = field(default_factory=dict)
    identify: Callable[[pd.DataFrame], str] | None = None
    passdown: tuple[str, ...] = ()

    def checked(self, configs: dict[str, dict[str, dict]]) -> None:
        """Errors of arguments, before any job starts."""
        if unknown := [h for h in self.hooks if h not in self.stages]:
            raise KeyError(f"hooks after no stage: {unknown}")
        for given in configs.values():
            if unknown := [s for s in given if s not in self.stages]:
                raise KeyError(f"options of no stage: {unknown}")
            for name, stage in self.stages.items():
                check_arguments(stage, given.get(name, {}))

    def run(self, samples: DataFrame, key: str, configs: dict[str, dict[str, dict]] | None = None) -> DataFrame:
        """``config, key, experiment_id, *passdown, stage, error`` and the columns of the schema; a failed job is one row with its stage and error."""
        configs = configs or {"default": {}}
        self.checked(configs)
        columns = samples.sparkSession.createDataFrame([], self.schema).columns
        stages, hooks, identify, passdown = self.stages, self.hooks, self.identify, self.passdown

        def of(name: str, rows: pd.DataFrame) -> pd.DataFrame:
            at, label, out = None, None, rows
            told = {c: rows[c].iloc[0] for c in passdown}
            try:
                if identify:
                    at = "identify"
                    label = str(identify(rows))
                for at, stage in stages.items():
                    out = stage(out, **configs[name].get(at, {}))
                    if at in hooks:
                        out = hooks[at](out)
                out = out[columns].reset_index(drop=True)
                status = {"stage": None, "error": None}
            except Exception:  # a job's failure is its result
                out = pd.DataFrame({c: [None] for c in columns})
                status = {"stage": at, "error": traceback.format_exc().strip().splitlines()[-1]}
            return pd.concat([pd.DataFrame({"config": name, key: rows[key].iloc[0], "experiment_id": label, **told, **status}, index=out.index), out], axis=1)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rows = pd.concat(batches, ignore_index=True)
            for name in configs:
                yield of(name, rows.copy())

        kinds = "".join(f", `{c}` {samples.schema[c].dataType.simpleString()}" for c in passdown)
        # the configurations of a recording share one copy of its rows, and one result is held at a time
        return samples.groupBy(key).applyInPandas(run, f"config string, `{key}` {samples.schema[key].dataType.simpleString()}, experiment_id string{kinds}, stage string, error string, {self.schema}")

    def save(self, results: DataFrame, path: str, configs: dict[str, dict[str, dict]] | None = None, mode: str = "errorifexists") -> None:
        """``trials`` (partitioned by configuration), ``status`` and ``parameters`` below ``path``, which must be new unless the mode says otherwise.

        The trials of a run without any success are a ValueError.
        """
        results.write.mode(mode).partitionBy("config").parquet(f"{path}/results")
        back = results.sparkSession.read.schema(results.schema).parquet(f"{path}/results")
        status(back, [c for c in results.columns if c not in ("config", "stage", "error")][0]).write.mode(mode).parquet(f"{path}/status")
        results.sparkSession.createDataFrame([(n, json.dumps(c, default=str, sort_keys=True)) for n, c in (configs or {"default": {}}).items()], "config string, parameters string").coalesce(1).write.mode(mode).json(f"{path}/parameters")
        finished(back)


def status(results: DataFrame, key: str) -> DataFrame:
    """A row per job: its rows, or the stage and error that ended it."""
    return results.groupBy("config", key).agg(F.sum(F.col("error").isNull().cast("long")).alias("rows"), F.max("stage").alias("stage"), F.max("error").alias("error"))


def parameters(path: str) -> dict:
    """Saved parameters of a local run."""
    lines = [line for p in sorted(Path(path).glob("parameters/*.json")) for line in p.read_text().splitlines()]
    return {r["config"]: json.loads(r["parameters"]) for r in map(json.loads, lines)}
