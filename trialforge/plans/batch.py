"""Batch pipelines: inputs x configurations, each job isolated from the failures of the others."""

from __future__ import annotations

import inspect
import itertools
import traceback
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def permutations_of(options: dict[str, list], defaults: dict | None = None) -> dict[str, dict]:
    """Full cross product of options, named after their values."""
    out = {}
    for i, values in enumerate(itertools.product(*options.values())):
        chosen = dict(zip(options, values, strict=True))
        out["_".join(f"{k}-{_plain(v)}" for k, v in chosen.items()) + f"_perm{i}"] = (defaults or {}) | chosen
    return out


def across(options: dict[str, list], defaults: dict | None = None) -> dict[str, dict]:
    """One option changed at a time, the others at their defaults."""
    each = [(k, v) for k, values in options.items() for v in values]
    return {f"{k}-{_plain(v)}_combo{i}": (defaults or {}) | {k: v} for i, (k, v) in enumerate(each)}


def _plain(v: object) -> str:
    return "".join(c if c.isalnum() or c in ".-" else "_" for c in str(v))


def check_arguments(f: Callable, given: dict, taken: int = 1) -> None:
    """TypeError for missing or unexpected keyword arguments, before any job starts; ``taken`` leading ones are the job's."""
    known = list(inspect.signature(f).parameters.values())[taken:]
    names = {p.name for p in known}
    open_ended = any(p.kind is p.VAR_KEYWORD for p in known)
    missing = [p.name for p in known if p.default is p.empty and p.kind in (p.POSITIONAL_OR_KEYWORD, p.KEYWORD_ONLY) and p.name not in given]
    extra = [] if open_ended else [k for k in given if k not in names]
    if missing or extra:
        raise TypeError(f"missing {missing}, unexpected {extra}")


def run(samples: DataFrame, key: str, job: Callable[..., pd.DataFrame], configs: dict[str, dict], schema: str) -> DataFrame:
    """``job(recording, **config)`` for every recording and configuration.

    The configurations of a recording share one copy of its rows and hand over
    one result at a time; a job that raises yields one row whose ``error``
    holds the last line of its traceback and no result.
    Returns ``config, key, error`` and the columns of ``schema``.
    """
    for config in configs.values():
        check_arguments(job, config)
    columns = samples.sparkSession.createDataFrame([], schema).columns

    def one(name: str, p: pd.DataFrame) -> pd.DataFrame:
        of = p[key].iloc[0]
        try:
            out = job(p, **configs[name])[columns].reset_index(drop=True)
            out.insert(0, "error", None)
        except Exception:  # a job's failure is its result
            out = pd.DataFrame({"error": [traceback.format_exc().strip().splitlines()[-1]], **{c: [None] for c in columns}})
        out.insert(0, key, of)
        out.insert(0, "config", name)
        return out

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(batches, ignore_index=True)
        for name in configs:
            yield one(name, rows.copy())

    kind = samples.schema[key].dataType.simpleString()
    return samples.groupBy(key).applyInPandas(each, f"config string, `{key}` {kind}, error string, {schema}")


def finished(results: DataFrame) -> DataFrame:
    """Rows of the jobs that succeeded; ValueError if none did."""
    good = results.where("error is null").drop("error")
    if good.isEmpty():
        raise ValueError("every job failed")
    return good
